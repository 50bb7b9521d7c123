"""BPE encoding and decoding by the merge automaton (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.automaton import compiled

SCHEMA = "n_tokens long, ids array<int>, decoded string"


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode whole texts and decode the ids again: one row (key, n_tokens, ids, decoded) per row of ``docs``.

    ``vocabulary`` is a byte-level vocabulary file that every executor can read. A null text counts as empty: no
    ids, an empty decoded text. Special tokens spelled out in a text become their ids, as the public tokenizers
    library has it. Repeated rows are encoded each; an empty table gives an empty result; other columns are not
    read, so their names can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(vocabulary)
        for batch in batches:
            packed = [automaton.encode_packed(t) for t in batch.column(1).to_pylist()]
            values = np.frombuffer(b"".join(packed), dtype=np.int32)
            offsets = np.zeros(len(packed) + 1, dtype=np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            decoded = pa.array([automaton.decode(values[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets).astype(np.int64)), ids, decoded], ["key", "n_tokens", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, {SCHEMA}")
    return out.withColumnRenamed("key", key)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """SHA-256 of the decimal ids and of the decoded text, computed from the operator's own output."""
    return encoded.select(
        key,
        "n_tokens",
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def token_lengths(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Encoded length (``n_tokens``) of every whole text; a null text has length 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(vocabulary)
        for batch in batches:
            n = [len(automaton.encode_packed(t)) // 4 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n_tokens"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "n_tokens long")
