"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams (operator 3)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.sampling import rows_of, sample_keys

#: Weights live in 2**BITS slots, so a model never exceeds 4 MB.
BITS = 20
#: Labelled documents that the fit reads, at most: those of the smallest hashes. Scoring covers all documents.
MAX_TRAINING_ROWS = 32_768
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.01
PREDICT_FROM = 0.7
#: Bytes of a word's stem; a stem is a feature of its own, so inflected forms share what was learnt.
STEM = 5
_STEM, _UNI, _BI, _SKIP = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def features(text: str | None) -> np.ndarray:
    """Distinct slots of a text's words, their stems, word pairs, and pairs with one word between; ASCII case is ignored."""
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.int64)
    h = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words)) + np.uint64(1)
    stems = np.fromiter(map(zlib.crc32, {w[:STEM] for w in words}), dtype=np.uint64) * _STEM
    uni = h * _UNI
    grams = [uni, stems]
    if len(h) > 1:
        grams.append((uni[:-1] ^ (uni[1:] >> np.uint64(7))) * _BI)
    if len(h) > 2:
        grams.append((uni[:-2] ^ (uni[2:] >> np.uint64(11))) * _SKIP)
    return np.unique((np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64))


class Ftrl:
    """Follow the regularised leader, with a rate of its own for each coordinate and L1 shrinkage to exact zeros."""

    def __init__(self) -> None:
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, slots: np.ndarray, label: int) -> None:
        at = np.append(slots, 1 << BITS)  # the last slot is the intercept
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-min(max(x, -50.0), 50.0))))


def held_out(key: Column) -> Column:
    """Rows that no fit may see: CRC-32 of the key as text leaves 1 modulo 3. A null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights that aren't zero, learnt from a bounded sample of the labelled rows that aren't held out.

    ``labels`` (doc_id, toxic): null labels are left out; where a document is labelled more than once, toxic wins; of
    rows that repeat an id one is learnt from, that of the smallest text.
    One task reads the sample once in the order of its hashes, so a fit repeats exactly. With no labelled rows
    there are no weights and every score is 0.5.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = sample_keys(known, "doc_id", MAX_TRAINING_ROWS, 3)
    marks = rows_of(known.select("doc_id", "toxic"), chosen, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(marks), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t).astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([f.tobytes() for f in found], pa.binary())], ["doc_id", "toxic", "slots"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl()
        for batch in batches:
            for slots, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                model.learn(np.frombuffer(slots, dtype=np.int32), int(label > 0))
        w = model.weights(np.arange((1 << BITS) + 1))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], ["slot", "weight"])

    key = docs.schema["doc_id"].dataType.simpleString()
    ready = rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(featurise, f"doc_id {key}, toxic int, slots binary")
    ordered = ready.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(3), "doc_id"), "doc_id", "slots")
    model = ordered.select("slots", "toxic").mapInArrow(learn, "slot int, weight double").toPandas()  # 2**BITS + 1 rows at most
    return model["slot"].to_numpy(np.int64), model["weight"].to_numpy(np.float64)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """Score (``out``, double, 0 to 1) of every whole text beside the columns ``keep``, whatever their names.

    An empty text has the intercept's score. Only ``out`` must not be among the names kept, if it is to be told apart.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.int32), model[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((1 << BITS) + 1)
        weights[shared.value[0]] = shared.value[1]
        for batch in batches:
            scores = [sigmoid(weights[features(t)].sum() + weights[-1]) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], [*keep, out])

    chosen = docs.select(F.col("text").cast("string").alias("__text"), *keep)
    return chosen.mapInArrow(run, T.StructType([*chosen.schema.fields[1:], T.StructField(out, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.7) for every row of ``docs``, scored whole.

    Only the text enters a score: labels, lang, source and doc_id don't. Null and empty texts get the intercept's
    score; repeated rows score alike; an empty table gives an empty result; other columns aren't read.
    """
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
