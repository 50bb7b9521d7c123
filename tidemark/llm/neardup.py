"""Near-duplicate documents by MinHash bands and odd sketches (operator 8).

A text's set of word shingles gives 128 MinHash samples. Bands of four samples propose candidates: at a similarity
of 0.8 all 32 bands miss a pair with a chance of 5e-8. The samples, folded by exclusive or into a bitmap of 512
bits, form the odd sketch: the bits in which two sketches differ estimate a high similarity closely enough to put
aside, at more than eight standard deviations, what can't reach the threshold. What is left is decided on full sets.

Texts of one set form a class with one representative. Inside a bucket only pairs with the bucket's smallest
representative are tried first; after components are known, the pairs between different components of a bucket
follow. Pairs inside a component are never needed, so a group of any size costs about as many pairs as members.

Buckets of more than CROWD rows that still hold several components, as texts made from one template give, aren't
paired all with all. Their documents are compared by their rarest shingles instead: of two sets that reach the
threshold, the smaller shares one of its rarest ninth with the rarest fifth of the larger. That loses no link, and texts
that share a template but not its filling share none of their rare shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import cut

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Two sketches of 0.8 similar sets differ in 46 bits on average; at 101 their similarity would be 0.5.
MOST_BITS_APART = 100
#: Rows up to which a group with several components is paired directly; rows times this bounds such pairs.
CROWD = 32
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K2
    x = (x ^ (x >> np.uint64(29))) * _K1
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; A-Z count as a-z.

    A text of fewer words is one shingle, a text without words has none.
    """
    found = text.encode("utf-8").lower().split() if text else []
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    span = min(words, len(h))
    out = np.full(len(h) - span + 1, span, dtype=np.uint64)
    for i in range(span):
        out = (out ^ (out >> np.uint64(31))) * _K1 + h[i : len(h) - span + 1 + i]
    return np.unique(_mix(out))


def _constants() -> tuple[np.ndarray, np.ndarray]:
    seeds = _mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * _K1)
    return seeds[:SAMPLES] | np.uint64(1), seeds[SAMPLES:]


def minhash(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """SAMPLES minima of multiply-add hashes, in blocks that bound the memory of a long text."""
    best = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 1024):
        block = s[i : i + 1024, None] * a
        block += b
        np.minimum(best, block.min(axis=0), out=best)
    return best


def band_keys(mins: np.ndarray) -> np.ndarray:
    rows = mins.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _K2
    for i in range(ROWS):
        key = _mix(key + rows[:, i])
    return key.view(np.int64)


def odd_sketch(mins: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as 64-bit words."""
    bits = _mix(mins + np.arange(SAMPLES, dtype=np.uint64) * _K1) & np.uint64(SKETCH_BITS - 1)
    odd = (np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (hi, lo), band keys and odd sketch of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _constants()
        for batch in batches:
            sizes, digests, keys, sketches = [], [], [], []
            for t in batch.column(1).to_pylist():
                s = shingles(t, words)
                mins = minhash(s, a, b)
                sizes.append(len(s))
                digests.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64))
                keys.append(band_keys(mins))
                sketches.append(odd_sketch(mins))
            n, d = len(sizes), np.array(digests, dtype=np.int64).reshape(-1, 2)
            listed = lambda x, k: pa.ListArray.from_arrays(
                pa.array(np.arange(0, (n + 1) * k, k, dtype=np.int32)), pa.array(np.concatenate(x) if n else np.empty(0, dtype=np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), listed(keys, BANDS), listed(sketches, SKETCH_BITS // 64)],
                ["doc_id", "n_shingles", "hi", "lo", "bands", "sketch"],
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_shingles long, hi long, lo long, bands array<long>, sketch array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and the full set of shingle hashes (array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words).view(np.int64) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate(sets) if sets else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def bits_apart(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for each node of the edges (a, b) the smallest node it can reach.

    Labels pass along edges and then to their labels' labels, so chains shorten by half in each round. Every round
    is written out; only the number of labels that changed comes to the driver.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("least"))
        stepped = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "least").alias("next"))
        stepped = cut(stepped)
        jump = stepped.select(F.col("node").alias("j_node"), F.col("next").alias("j_next"))
        jumped = cut(stepped.join(jump, F.col("next") == F.col("j_node"), "left").select("node", F.coalesce(F.least("next", "j_next"), "next").alias("label"), (F.col("label") != F.coalesce(F.least("next", "j_next"), "next")).alias("moved")))
        labels = jumped.select("node", "label")
        if not jumped.filter("moved").limit(1).count():
            return labels


def confirmed(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the candidate pairs (a, b) that reach the threshold: by odd sketches first, then on full sets."""
    s = sketches.select("doc_id", "n_shingles", "sketch")
    x, y = (s.select(F.col("doc_id").alias(i), F.col("n_shingles").alias(f"n_{i}"), F.col("sketch").alias(f"s_{i}")) for i in "ab")
    near = pairs.join(x, "a").join(y, "b").filter(
        (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (bits_apart(F.col("s_a"), F.col("s_b")) <= MOST_BITS_APART)
    )
    near = cut(near.select("a", "b", "n_a", "n_b").distinct())
    u, v = (sets.select(F.col("doc_id").alias(i), F.col("shingles").alias(f"set_{i}")) for i in "ab")
    both = near.join(u, "a").join(v, "b").select("a", "b", "n_a", "n_b", F.size(F.array_intersect("set_a", "set_b")).alias("shared"))
    return cut(both.filter(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b"))


def _open(groups: DataFrame) -> DataFrame:
    """Rows of the groups (key) that hold several components (label), with the number of each group's rows."""
    several = groups.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("rows")).filter("low < high")
    return groups.join(several.select("key", "rows"), "key")


def _across(rows: DataFrame, extra: Column | None = None) -> DataFrame:
    """Pairs (a, b) of rows of one group and different components; ``extra`` is a condition on both sides' columns."""
    x, y = (rows.select("key", *(F.col(c).alias(f"{c}_{i}") for c in rows.columns if c not in ("key", "rows"))) for i in "xy")
    pairs = x.join(y, "key").filter("label_x < label_y" if extra is None else F.expr("label_x <> label_y") & extra)
    return pairs.select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b")).distinct()


def rare_shingles(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Groups (key, doc_id, label, n, low) of documents by their rarest shingles, frequent ones in the crowd last.

    With n shingles, a set of 100 * intersection >= percent * union has a shingle among its n - ceil(percent * n / 100)
    + 1 rarest in common with the other; where the other is no smaller, even among its rarest n - ceil(2 * percent * n /
    (100 + percent)) + 1, which are marked ``low``.
    """
    members = crowd.join(sets, "doc_id").select("doc_id", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    counts = members.groupBy("key").agg(F.count("*").alias("times"))
    ranked = members.join(counts, "key").withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("times", "key")))
    least = F.expr(f"n - ({percent} * n + 99) div 100 + 1")
    lower = F.expr(f"n - (2 * {percent} * n + {100 + percent - 1}) div {100 + percent} + 1")
    return ranked.filter((F.col("place") <= least) & (F.col("times") > 1)).select("key", "doc_id", "label", "n", (F.col("place") <= lower).alias("low"))


def crowd_links(crowd: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of a crowd (doc_id, label) by rare shingles, the smallest document of each
    shingle first, then pairs between what is still apart."""
    near = F.expr(f"low_x and n_x <= n_y and 100 * n_x >= {percent} * n_y")
    rare = cut(rare_shingles(crowd, sets, percent))
    groups = _open(rare)
    leaders = rare.groupBy("key").agg(F.min("doc_id").alias("leader"))
    large = groups.filter(F.col("rows") > CROWD).join(leaders, "key").filter("doc_id <> leader")
    first = confirmed(large.select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct(), reps, sets, percent)
    labels = components(first.unionByName(crowd.filter("doc_id <> label").select(F.col("label").alias("a"), F.col("doc_id").alias("b"))))
    moved = cut(rare.join(labels.withColumnRenamed("label", "fresh"), F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("fresh", "label").alias("label"), "n", "low"))
    return first.unionByName(confirmed(_across(_open(moved), near), reps, sets, percent))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    Documents whose shingle sets have 100 * intersection >= percent * union are linked; component_id is the
    smallest doc_id reachable and kept marks that document. Null and empty texts have no shingles and no links.
    Rows that repeat an id belong together; a null id is linked with nothing, has a null component and is kept. An empty
    table gives an empty result; other columns than these two aren't read, so their names can't clash.
    """
    if percent < 80:
        raise ValueError("bands and sketches are set for similarities of 0.8 and more")
    signed = cut(signatures(docs, words))
    linked = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = cut(linked.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")))
    reps = cut(linked.join(classes, ["hi", "lo"]).filter("doc_id = rep").select("doc_id", "n_shingles", "bands", "sketch"))

    rows = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).filter("leader < last")
    # Every row of a bucket with two or more classes; a hot bucket's rows are split by adaptive skew handling.
    bucketed = cut(rows.join(buckets.select("key", "leader"), "key"))
    wanted = bucketed.select("doc_id").distinct()
    sets = cut(shingle_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(wanted, "doc_id", "left_semi"), words))

    stars = bucketed.filter("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = confirmed(stars, reps, sets, percent)
    labels = components(links)
    placed = bucketed.join(labels, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    open_rows = cut(_open(placed))
    more = confirmed(_across(open_rows.filter(F.col("rows") <= CROWD)), reps, sets, percent)
    crowd = cut(open_rows.filter(F.col("rows") > CROWD).select("doc_id", "label").distinct())
    if crowd.limit(1).count():
        more = more.unionByName(crowd_links(crowd, reps, sets, percent))
    found = components(links.union(more)) if more.limit(1).count() else labels

    members = linked.select("doc_id", "n_shingles", "hi", "lo").join(classes, ["hi", "lo"])
    with_links = members.join(found, F.col("rep") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    alone = signed.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_links.union(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
