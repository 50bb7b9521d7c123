"""Removal of repeated passages by level-wise doubling (operator 7).

A passage of 35 words that occurs twice is found from short windows up. Each window of 35 words has an anchor: of
its windows of 9 words the one with the smallest hash, the same wherever the words are the same. Anchors repeated at
9 words are extended to 18, to the side or sides that the window holds; what is repeated at 18 alone is extended to
the full length. There, neighbouring windows with one anchor are first compared together, as one segment; only where
a segment occurs once are its windows compared one by one. Short windows only propose; full windows are compared by
128-bit digests of their words.

What moves between machines is hashes, and the texts of documents with a repeated anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import cut

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(31))) * _K1 + b
    x = (x ^ (x >> np.uint64(32))) * _K2
    return x ^ (x >> np.uint64(29))


def gram_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` words from word hashes, by doubling."""
    whole, span = h, 1
    while span * 2 <= length:
        whole = _pair(whole[:-span], whole[span:]) if len(whole) > span else whole[:0]
        span *= 2
    if span < length:
        rest = length - span
        whole = _pair(whole[: len(whole) - rest], whole[rest:]) if len(whole) > rest else whole[:0]
    return whole


class Windows:
    """Words of a text, and the anchors of its windows with the starts that share them."""

    def __init__(self, text: str | None, window: int):
        self.words = text.encode("utf-8").split() if text else []
        self.window, self.short = window, -(-window // 4)
        n = len(self.words)
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), dtype=np.uint64, count=n)
        if n < window:
            self.anchors = self.first = self.last = np.empty(0, dtype=np.int64)
            self.grams = np.empty(0, dtype=np.uint64)
            return
        self.grams = gram_hashes(self.hashes, self.short)
        reach = window - self.short + 1
        starts = np.arange(n - window + 1)
        at = starts + np.lib.stride_tricks.sliding_window_view(self.grams, reach).argmin(axis=1)
        turns = np.flatnonzero(np.diff(at)) + 1
        self.first = np.concatenate([[0], turns])
        self.last = np.concatenate([turns - 1, [len(at) - 1]])
        self.anchors = at[self.first]

    def anchor_hashes(self) -> np.ndarray:
        return self.grams[self.anchors].view(np.int64)

    def digest(self, start: int, end: int) -> tuple[int, int]:
        raw = xxhash.xxh3_128_digest(self.hashes[start:end].tobytes())
        return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _lists(values: list, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else [], kind))


def _row_key() -> list[Column]:
    """Tells rows apart even where ids repeat; rows equal in id and text share it, and their result."""
    return [F.coalesce(F.col("doc_id"), F.lit(-1)).alias("k1"), F.xxhash64("text", "doc_id").alias("k2")]


def _anchors(rows: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Windows(t, window) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array([len(w.words) for w in found], pa.int64()),
                    pa.array([hashlib.sha256(b" ".join(w.words)).hexdigest() for w in found]),
                    _lists([w.anchor_hashes() for w in found], pa.int64()),
                ],
                ["k1", "k2", "doc_id", "n_words", "sha256", "anchors"],
            )

    return rows.select("k1", "k2", "doc_id", "text").mapInArrow(run, "k1 long, k2 long, doc_id long, n_words long, sha256 string, anchors array<long>")


def _extended(rows: DataFrame, window: int) -> DataFrame:
    """For each anchor among ``hits``: its windows of twice the short length to either side, and its segment's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k1, k2, text, hits in zip(*(c.to_pylist() for c in batch.columns)):
                w = Windows(text, window)
                wide = gram_hashes(w.hashes, 2 * w.short).view(np.int64)
                chosen = np.isin(w.anchor_hashes(), np.array(hits, dtype=np.int64))
                for p, a, b in zip(w.anchors[chosen].tolist(), w.first[chosen].tolist(), w.last[chosen].tolist()):
                    # The right extension lies inside some window of this anchor, or the left one does, or both.
                    right = int(wide[p]) if p - b + 2 * w.short <= window and p < len(wide) else None
                    left = int(wide[p - w.short]) if p - a >= w.short else None
                    out.append((k1, k2, p, int(w.grams[p].view(np.int64)), right, left, *w.digest(a, b + window)))
            columns = list(zip(*out)) if out else [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["k1", "k2", "p", "gram", "r", "l", "hi", "lo"])

    return rows.select("k1", "k2", "text", "hits").mapInArrow(run, "k1 long, k2 long, p int, gram long, r long, l long, hi long, lo long")


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """Digests of the single windows of the anchors marked ``expand``; weight 2 where the segment is known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k1, k2, text, marks in zip(*(c.to_pylist() for c in batch.columns)):
                wanted = {m["p"]: 1 + m["repeated"] for m in marks if m["expand"]}
                if not wanted:
                    continue
                w = Windows(text, window)
                for p, a, b in zip(w.anchors.tolist(), w.first.tolist(), w.last.tolist()):
                    if p in wanted:
                        out += [(k1, k2, i, wanted[p], *w.digest(i, i + window)) for i in range(a, b + 1)]
            columns = list(zip(*out)) if out else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["k1", "k2", "start", "weight", "hi", "lo"])

    return rows.select("k1", "k2", "text", "marks").mapInArrow(run, "k1 long, k2 long, start int, weight int, hi long, lo long")


def _removed(rows: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k1, k2, text, marks, starts in zip(*(c.to_pylist() for c in batch.columns)):
                w = Windows(text, window)
                edge = np.zeros(len(w.words) + 1, dtype=np.int64)
                repeated = {m["p"] for m in marks if m["repeated"]}
                for p, a, b in zip(w.anchors.tolist(), w.first.tolist(), w.last.tolist()):
                    if p in repeated:
                        edge[a] += 1
                        edge[b + window] -= 1
                for i in starts or ():
                    edge[i] += 1
                    edge[i + window] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join([x for x, g in zip(w.words, gone.tolist()) if not g])
                out.append((k1, k2, int(gone.sum()), kept.decode("utf-8"), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["k1", "k2", "n_removed", "kept_text", "kept_sha256"])

    return rows.select("k1", "k2", "text", "marks", "starts").mapInArrow(run, "k1 long, k2 long, n_removed long, kept_text string, kept_sha256 string")


def _repeated(hashes: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur twice or more; counted before the shuffle, so a hot key is one row a task."""
    return hashes.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys)


def repeated_passages(docs: DataFrame, window: int = 35, with_text: bool = True) -> DataFrame:
    """Remove from each text all words covered by a window of ``window`` words that also starts anywhere else.

    Returns doc_id, n_words, n_removed, kept_sha256 and, for texts that lost words, ``kept_text`` (null where nothing
    went). Windows never cross documents and are judged on the input. Null texts and texts shorter than a window
    lose nothing; equal rows count as two places; a null id is kept as it is.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = text.select(*_row_key(), "doc_id", "text")
    per_doc = cut(_anchors(rows, window))
    single = per_doc.select("k1", "k2", F.explode("anchors").alias("gram"))
    hits = single.join(_repeated(single.select("gram"), "gram"), "gram").groupBy("k1", "k2").agg(F.collect_set("gram").alias("hits"))
    candidates = cut(rows.select("k1", "k2", "text").join(hits, ["k1", "k2"]))

    level = cut(_extended(candidates, window))
    halves = level.select(F.explode(F.array("r", "l")).alias("half")).filter("half is not null")
    twice = _repeated(halves, "half")
    # Each anchor has one side at least; it stands in for one that is missing, so no null gathers in a partition.
    level = (
        level.withColumns({"r": F.coalesce("r", "l"), "l": F.coalesce("l", "r")})
        .join(twice.withColumnRenamed("half", "r2"), F.col("r") == F.col("r2"), "left")
        .join(twice.withColumnRenamed("half", "l2"), F.col("l") == F.col("l2"), "left")
        .filter("r2 is not null or l2 is not null")
        .select("k1", "k2", "p", "gram", "hi", "lo")
    )
    level = cut(level)
    segments = level.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "p")).alias("one"))
    judged = cut(level.join(segments, ["hi", "lo"]).select("k1", "k2", "p", "gram", (F.col("n") > 1).alias("repeated"), (F.struct("k1", "k2", "p") == F.col("one")).alias("is_one")))
    # A segment that occurs once may still share windows with one that repeats, so one copy of that joins in.
    unsettled = judged.filter("not repeated").select(F.col("gram").alias("open_gram")).distinct()
    marks = (
        judged.join(unsettled, F.col("gram") == F.col("open_gram"), "left")
        .select("k1", "k2", "p", "repeated", (~F.col("repeated") | (F.col("is_one") & F.col("open_gram").isNotNull())).alias("expand"))
        .filter("repeated or expand")
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.struct("p", "repeated", "expand")).alias("marks"))
    )
    marked = cut(candidates.join(marks, ["k1", "k2"]))
    full = cut(_windows(marked, window))
    again = full.groupBy("hi", "lo").agg(F.sum("weight").alias("places")).filter("places > 1").select("hi", "lo")
    starts = full.filter("weight = 1").join(again, ["hi", "lo"]).groupBy("k1", "k2").agg(F.collect_set("start").alias("starts"))
    done = _removed(marked.join(starts, ["k1", "k2"], "left"), window)
    done = cut((done if with_text else done.drop("kept_text")).dropDuplicates(["k1", "k2"]).filter("n_removed > 0"))
    out = per_doc.select("k1", "k2", "doc_id", "n_words", "sha256").join(done, ["k1", "k2"], "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
        *(["kept_text"] if with_text else []),
    )
