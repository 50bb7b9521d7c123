"""Token ids in binary files with a shared compression dictionary (operator 5).

A folder holds ``dictionary.zdict`` and files ``part-NNNNNN.tok``, in ascending order of document id::

    payload   each document's ids, little-endian 16- or 32-bit, as one zstandard frame
    index     doc_id int64[n], valid uint8[n], end uint64[n] (of its frame in the payload), n_ids uint32[n]
    footer    magic, bytes per id, n, ids in the file, payload bytes, SHA-256 of the dictionary

A short document costs one read of its frame: the index gives its place, the dictionary what it shares with others.
"""

from __future__ import annotations

import bisect
import gc
import hashlib
import json
import math
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.sampling import rows_of, sample_keys
from tidemark.runtime import cut

MAGIC = b"TIDETOK1"
FOOTER = struct.Struct("<8sIQQQ32s")
#: Documents whose ids train the dictionary, and the dictionary's size; neither grows with the corpus.
SAMPLE_DOCS = 512
SAMPLE_BYTES = 1 << 14
DICTIONARY_BYTES = 1 << 16
LEVEL = 3
#: Words that a generation of a worker's table holds, and the bytes that they may take together.
WORDS_KEPT, WORD_BYTES_KEPT = 400_000, 16 << 20
#: Bytes of frames that a file is meant for; a table smaller than this for each shuffle partition has one file for each.
FILE_BYTES = 256 << 20
LETTER_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _parts(spec: dict | None, inner: str) -> list[dict]:
    """The steps of a normalizer or pre-tokenizer, sequences opened."""
    if spec is None:
        return []
    return [x for step in spec[inner] for x in _parts(step, inner)] if spec["type"] == "Sequence" else [spec]


def parts_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer drops white space and lets no token and no normalizing step reach across it.

    True only of what is known to: each text is composed (NFC) and lower-cased, runs of white space become a blank,
    and a pattern without white space picks the pieces. Such a text's ids are those of its words, one after another.
    """
    steps, cuts = _parts(spec["normalizer"], "normalizers"), _parts(spec["pre_tokenizer"], "pretokenizers")
    blanks = all(x["type"] in ("NFC", "Lowercase") or (x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " ") for x in steps)
    picks = bool(cuts) and cuts[0] == {"type": "Split", "pattern": {"Regex": LETTER_PIECES}, "behavior": "Removed", "invert": True}
    bytes_only = all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in cuts[1:])
    apart = all(not (t["lstrip"] or t["rstrip"] or " " in t["content"]) for t in spec["added_tokens"])
    lower = {x["type"] for x in steps} >= {"NFC", "Lowercase"}
    return blanks and picks and bytes_only and apart and lower and spec["post_processor"] is None and not spec["model"].get("dropout")


class _Words(dict):
    """Packed ids of words, learnt when first asked for. Two generations: once one is full, the older goes."""

    def __init__(self, learn: Callable[[bytes], bytes], former: dict[bytes, bytes]):
        super().__init__()
        self.learn, self.former, self.held = learn, former, 0

    def __missing__(self, word: bytes) -> bytes:
        ids = self.former.get(word)
        if ids is None:
            ids = self.learn(word)
        self.held += len(word) + len(ids)
        self[word] = ids
        return ids

    def turned(self) -> _Words:
        if len(self) <= WORDS_KEPT and self.held <= WORD_BYTES_KEPT:
            return self
        self.former = {}
        return _Words(self.learn, self)


class WordTokenizer:
    """Whole-text encoding by the tokenizers library.

    Of vocabularies that part texts at white space (``parts_at_spaces``) each distinct word goes through the library
    once and is then looked up. Words of plain letters, with or without stops behind them, are put together from
    their parts, so that their letters are seen once whatever their case and stops; such letters are one piece, and
    the library's model has them at once. With any other vocabulary every text goes through whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_words = parts_at_spaces(json.loads(self.tokenizer.to_str()))
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self._bytes = {i: spell(chr(i))[0][0] for i in range(0xDF, 0x100)}
        self._merged = self.tokenizer.model.tokenize
        self._plain = re.compile("([a-zà-öø-ÿ]+)([.,;:!?]*)").fullmatch
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._words = _Words(self._learn, {})
        self._letters = _Words(self._learn_letters, {})

    def _pack(self, ids: list[int]) -> bytes:
        return array(self._code, ids).tobytes()

    def _each(self, word: str) -> bytes:
        return self._pack(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _learn_letters(self, word: str) -> bytes:
        return self._pack([t.id for t in self._merged(word if word.isascii() else word.translate(self._bytes))])

    def _learn(self, raw: bytes) -> bytes:
        # Composing and lower-casing are what the vocabulary does first, so a word may be plain once it is lower-cased.
        word = raw.decode("utf-8")
        m = self._plain(word.lower())
        if not m:
            return self._each(word)
        letters, stops = m.groups()
        ids = self._letters[letters]
        return ids + self._words_of_stops(stops) if stops else ids

    def _words_of_stops(self, stops: str) -> bytes:
        ids = self._letters.get(stops)
        if ids is None:
            ids = self._letters[stops] = self._each(stops)
        return ids

    def encode_all(self, texts: list[str | None], end: int) -> list[bytes]:
        """Ids of each text followed by ``end``, packed in ``dtype``; a null text has only ``end``."""
        tail = self._pack([end])
        if not self.by_words:
            return [self._pack(e.ids) + tail for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        collecting = gc.isenabled()
        gc.disable()  # nothing here refers back to itself, and a collection would walk through all the words
        try:
            self._words, self._letters = self._words.turned(), self._letters.turned()
            known = self._words.__getitem__
            return [b"".join(map(known, t.encode("utf-8").split())) + tail if t else tail for t in texts]
        finally:
            if collecting:
                gc.enable()


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def train_dictionary(docs: DataFrame, vocabulary: str, end: int) -> tuple[bytes, float]:
    """A zstandard dictionary from the serialized ids of a bounded sample of documents; empty for an empty table.

    Beside it, the mean bytes of a sampled document's frame, for laying out files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(vocabulary)
        whole = sorted(ids for batch in batches for ids in tokenizer.encode_all(batch.column(0).to_pylist(), end))
        samples = [ids[:SAMPLE_BYTES] for ids in whole]
        made, mean = b"", 0.0
        if samples:
            try:
                made = zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
            except zstandard.ZstdError:  # too little to train on: the samples themselves serve
                made = b"".join(samples)[-DICTIONARY_BYTES:]
            compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(made))
            mean = sum(len(compressor.compress(ids)) for ids in whole) / len(whole)
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary()), pa.array([mean])], ["dictionary", "mean"])

    chosen = rows_of(docs.select("doc_id", "text"), sample_keys(docs, "doc_id", SAMPLE_DOCS, 5), "doc_id")
    made = chosen.select("text").repartition(1).mapInArrow(run, "dictionary binary, mean double").collect()
    return (bytes(made[0]["dictionary"]), made[0]["mean"]) if made else (b"", 0.0)


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    if not raw:
        return None
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(raw, dict_type=kind)


def _bounds(docs: DataFrame, files: int | None, mean: float) -> list[int]:
    """Ids that part the table into ranges of about as many rows each; reads the id column only.

    Without ``files``, frames of ``mean`` bytes give as many as keep a file at FILE_BYTES, and one for each shuffle
    partition at least.
    """
    if files is None:
        least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        files = max(least, math.ceil(docs.count() * mean / FILE_BYTES))
    if files < 2:
        return []
    shares = [i / files for i in range(1, files)]
    found = docs.select(F.percentile_approx("doc_id", shares, max(10_000, 20 * files)).alias("b")).first()["b"]
    return sorted(set(found or []))


def footer(width: int, documents: int, ids: int, payload: int, digest: bytes) -> bytes:
    return FOOTER.pack(MAGIC, width, documents, ids, payload, digest)


def write_files(docs: DataFrame, folder: str, vocabulary: str, end: int, files: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write them to ``folder``; returns the manifest (file, path, n_docs, n_ids).

    Texts are encoded and compressed where they are read; only frames are shuffled, by ranges of ids. A task writes
    to a name of its own and renames at the end, so a repeated task leaves the same whole file. Null ids come first,
    equal ids in the order of their frames; an empty table writes no file.
    """
    spark = docs.sparkSession
    raw, mean = train_dictionary(docs, vocabulary, end)
    digest = hashlib.sha256(raw).digest()
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary.zdict") as out:
        out.write(raw)
    bounds = _bounds(docs, files, mean)
    shared = spark.sparkContext.broadcast(raw)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(vocabulary)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value))
        for batch in batches:
            keys = batch.column(0).to_pylist()
            packed = tokenizer.encode_all(batch.column(1).to_pylist(), end)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0 if k is None else bisect.bisect_left(bounds, k) for k in keys], pa.int32()),
                    batch.column(0),
                    pa.array([len(p) // tokenizer.dtype.itemsize for p in packed], pa.int64()),
                    pa.array([compressor.compress(p) for p in packed], pa.binary()),
                ],
                ["file", "doc_id", "n_ids", "frame"],
            )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        width = word_tokenizer(vocabulary).dtype.itemsize
        out, number, temporary = None, -1, ""
        keys: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                number = batch.column(0)[0].as_py()
                temporary = f"{root}/_{number:06d}-{uuid.uuid4().hex}"
                out = fs.open_output_stream(temporary)
            frames = batch.column(3).to_pylist()
            out.write(b"".join(frames))
            valid = np.array([k is not None for k in batch.column(1).to_pylist()], dtype=np.uint8)
            ids = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            keys.append(np.rec.fromarrays([ids, valid, np.array([len(f) for f in frames]), batch.column(2).to_numpy()], dtype="i8,u1,u8,u4"))
        if out is None:
            return
        index = np.concatenate(keys)
        ends = np.cumsum(index["f2"], dtype="<u8")
        total = int(index["f3"].sum(dtype=np.uint64))
        for part in (index["f0"].astype("<i8"), index["f1"].astype("u1"), ends, index["f3"].astype("<u4")):
            out.write(part.tobytes())
        out.write(footer(width, len(index), total, int(ends[-1]), digest))
        out.close()
        final = f"{root}/part-{number:06d}.tok"
        fs.move(temporary, final)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([final]), pa.array([len(index)], pa.int64()), pa.array([total], pa.int64())], ["file", "path", "n_docs", "n_ids"])

    encoded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, "file int, doc_id long, n_ids long, frame binary")
    ordered = encoded.repartitionById(len(bounds) + 1, "file").sortWithinPartitions("doc_id", "frame")
    return cut(ordered.mapInArrow(write, "file int, path string, n_docs long, n_ids long"))


def open_file(fs: pafs.FileSystem, path: str, raw: bytes):
    """Index of a file and a reader of single documents: (ids, valid, n_ids, fetch(i) -> array of ids)."""
    source = fs.open_input_file(path)
    source.seek(source.size() - FOOTER.size)
    magic, width, n, _, payload, digest = FOOTER.unpack(source.read(FOOTER.size))
    if magic != MAGIC or digest != hashlib.sha256(raw).digest():
        raise ValueError(f"{path}: not a token file of this dictionary")
    source.seek(payload)
    keys, valid, ends, counts = (np.frombuffer(source.read(n * np.dtype(d).itemsize), dtype=d) for d in ("<i8", "u1", "<u8", "<u4"))
    starts = np.concatenate([[0], ends[:-1].astype(np.int64)]).astype(np.int64)
    decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
    dtype = np.dtype("<u2" if width == 2 else "<u4")

    def fetch(i: int) -> np.ndarray:
        source.seek(int(starts[i]))
        frame = source.read(int(ends[i]) - int(starts[i]))
        return np.frombuffer(decompressor.decompress(frame, max_output_size=int(counts[i]) * width), dtype=dtype)

    return keys, valid, counts, fetch


def read_files(manifest: DataFrame, folder: str, digest: bool = False) -> DataFrame:
    """Read every file of a manifest back: doc_id, start, n_tokens, ids (array<int>), in the files' order.

    ``start`` counts the ids of all documents before, across files. With ``digest`` there is, instead of the ids,
    ``ids_crc32``: the CRC-32 of what was read, as little-endian unsigned 32-bit integers.
    """
    before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    placed = manifest.select("file", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    count = max(1, manifest.count())

    def column(ids: list[np.ndarray]) -> pa.Array:
        if digest:
            return pa.array([zlib.crc32(x.astype("<u4")) for x in ids], pa.int64())
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        with fs.open_input_stream(f"{root}/dictionary.zdict") as f:
            raw = f.read()
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, valid, counts, fetch = open_file(fs, path, raw)
                starts = base + np.concatenate([[0], np.cumsum(counts[:-1], dtype=np.int64)])
                for a in range(0, len(keys), 256):
                    b = min(a + 256, len(keys))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[a:b], mask=valid[a:b] == 0), pa.array(starts[a:b]), pa.array(counts[a:b].astype(np.int64)), column([fetch(i) for i in range(a, b)])],
                        ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                    )

    spread = placed.repartitionById(count, F.expr(f"cast(file % {count} as int)")).select("path", "base")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>"))
