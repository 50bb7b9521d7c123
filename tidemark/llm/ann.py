"""Nearest neighbours by learned partitions (operator 9).

A bounded sample gives a graph of nearest neighbours. The graph is cut into partitions of equal size with few edges
between them, and a small network learns to tell, from a vector alone, which partitions hold its neighbours; its biases
are then set so that it fills the partitions evenly. Every row is indexed in its most probable partition; a query visits
its most probable ones, as many as rows kept out of the fit show to be needed for the recall asked for, and what it
finds there is ranked by exact inner products.

Partitions grow in number with the rows: each of the FAN_OUT partitions of a large table is parted again, by a network
fitted to a sample of its own rows, and a partition's probability is the product of both. A model stays within 6 MB.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.sampling import rows_of, sample_keys
from tidemark.runtime import cut

#: Rows that one network's fit reads, at most; the index holds all rows.
SAMPLE_ROWS = 4096
GRAPH_DEGREE = 16
ROWS_PER_PARTITION = 1024
#: Partitions that one network tells apart, at least and at most; two levels of networks make FAN_OUT ** 2 at most.
LEAST_PARTITIONS, FAN_OUT = 4, 64
#: One sample row in so many is kept out of the fit, to set the number of probes.
KEPT_OUT = 4
#: Share of those rows' true neighbours in the sample that the visited partitions must hold.
COVERAGE = 0.96
BLOCK_ROWS, QUERY_ROWS = 16_384, 4_096
HIDDEN, STEPS, BATCH = 64, 300, 512


def balanced_partition(graph: np.ndarray, x: np.ndarray, m: int) -> np.ndarray:
    """Labels 0..m-1 of equal sizes (within one) for the nodes of a neighbour graph, m a power of two.

    Nodes start in halves of halves along principal directions; then pairs of nodes swap labels wherever that
    saves edges between partitions.
    """
    n = len(x)
    label = np.zeros(n, dtype=np.int64)
    parts = [np.arange(n)]
    while len(parts) < m:
        halves = []
        for p in parts:
            c = x[p] - x[p].mean(axis=0) if len(p) else x[p]
            axis = np.linalg.svd(c, full_matrices=False)[2][0] if len(p) > 1 else np.zeros(x.shape[1])
            order = p[np.argsort(c @ axis, kind="stable")]
            halves += [order[: len(p) // 2], order[len(p) // 2 :]]
        parts = halves
    for i, p in enumerate(parts):
        label[p] = i
    for _ in range(12):
        votes = np.zeros((n, m))
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), label[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(label, graph.shape[1])), 1)
        gain = votes - votes[np.arange(n), label][:, None]
        best = gain.argmax(axis=1)
        wish = np.flatnonzero(gain[np.arange(n), best] > 0)
        wish = wish[np.argsort(-gain[wish, best[wish]], kind="stable")]
        waiting: dict[tuple[int, int], list[int]] = {}
        swapped = 0
        for v in wish.tolist():
            a, b = int(label[v]), int(best[v])
            if waiting.get((b, a)):
                u = waiting[b, a].pop()
                label[u], label[v] = a, b
                swapped += 1
            else:
                waiting.setdefault((a, b), []).append(v)
        if not swapped:
            break
    return label


class Router:
    """One hidden layer; probabilities of the partitions that hold a vector's neighbours."""

    def __init__(self, w1, b1, w2, b2, scale: float = 1.0):
        self.w1, self.b1, self.w2, self.b2, self.scale = w1, b1, w2, b2, float(scale)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"w1": self.w1, "b1": self.b1, "w2": self.w2, "b2": self.b2, "scale": np.float64(self.scale)}


class Tree:
    """A network over partitions and, for a large table, one inside each of them."""

    def __init__(self, root: Router, inner: list[Router] | None = None):
        self.root, self.inner = root, inner or []

    @property
    def leaves(self) -> int:
        return self.root.w2.shape[1] * (self.inner[0].w2.shape[1] if self.inner else 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        p = self.root(x)
        return np.concatenate([p[:, [i]] * net(x) for i, net in enumerate(self.inner)], axis=1) if self.inner else p

    def home(self, x: np.ndarray) -> np.ndarray:
        """The partition of each row: that of the root first, then the most probable one inside."""
        part = self.root(x).argmax(axis=1)
        if not self.inner:
            return part
        leaf = np.zeros(len(x), dtype=np.int64)
        for i in np.unique(part):
            at = np.flatnonzero(part == i)
            leaf[at] = i * self.inner[i].w2.shape[1] + self.inner[i](x[at]).argmax(axis=1)
        return leaf

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f"{i}_{k}": v for i, net in enumerate([self.root, *self.inner]) for k, v in net.arrays().items()})
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Tree:
        held = np.load(io.BytesIO(raw))
        nets: dict[int, dict] = {}
        for name in held.files:
            i, k = name.split("_", 1)
            nets.setdefault(int(i), {})[k] = held[name]
        root, *inner = [Router(**nets[i]) for i in sorted(nets)]
        return Tree(root, inner)


def _train(x: np.ndarray, goal: np.ndarray, rng: np.random.Generator) -> Router:
    scale = float(np.sqrt((x * x).sum(axis=1).mean() / x.shape[1])) or 1.0
    net = Router(rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.05, (HIDDEN, goal.shape[1])), np.zeros(goal.shape[1]), scale)
    params = [net.w1, net.b1, net.w2, net.b2]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        at = rng.integers(0, len(x), min(BATCH, len(x)))
        xs = x[at] / scale
        hidden = np.maximum(xs @ net.w1 + net.b1, 0)
        d = (net(x[at]) - goal[at]) / len(at)
        back = (d @ net.w2.T) * (hidden > 0)
        for i, g in enumerate((xs.T @ back, back.sum(axis=0), hidden.T @ d, d.sum(axis=0))):
            g = g + 1e-4 * params[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] -= 0.01 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return net


def balance(net: Router, x: np.ndarray) -> None:
    """Set the biases so that the rows' most probable partitions hold about as many rows each."""
    z = net.logits(x) - net.b2
    bias, best, m = net.b2.copy(), None, net.w2.shape[1]
    rate = 0.3 * float(z.std())
    for step in range(120):
        counts = np.bincount((z + bias).argmax(axis=1), minlength=m)
        if best is None or counts.max() < best[0]:
            best = (counts.max(), bias.copy())
        bias = bias + rate / (1 + step / 20) * np.log((len(x) / m + 1) / (counts + 1))
    net.b2 = best[1]


def _closest(x: np.ndarray, degree: int) -> np.ndarray:
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    return np.argpartition(-s, degree - 1, axis=1)[:, :degree]


def fit_router(x: np.ndarray, m: int) -> Router:
    """Graph, balanced partition and network from sample vectors (double); one row in KEPT_OUT takes no part."""
    rng = np.random.default_rng(9)
    fitted = x[np.arange(len(x)) % KEPT_OUT != KEPT_OUT - 1]
    n = len(fitted)
    if n < 2:
        return Router(np.zeros((x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, m)), np.zeros(m))
    degree = min(GRAPH_DEGREE, n - 1)
    graph = _closest(fitted, degree)
    label = balanced_partition(graph, fitted, m)
    goal = np.zeros((n, m))
    np.add.at(goal, (np.repeat(np.arange(n), degree), label[graph].ravel()), 1 / (degree + 1))
    goal[np.arange(n), label] += 1 / (degree + 1)
    net = _train(fitted, goal, rng)
    balance(net, fitted)
    return net


def probes_needed(tree: Tree, x: np.ndarray, k: int) -> int:
    """Partitions that rows kept out of the fit must visit to find COVERAGE of their ``k`` nearest in the sample."""
    n, m = len(x), tree.leaves
    asked = np.arange(KEPT_OUT - 1, n, KEPT_OUT)
    if not len(asked):
        return 1
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    k = min(k, n - 1)
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    p, home = tree(x[asked]), tree.home(x)
    place = np.empty((len(asked), m), dtype=np.int32)
    np.put_along_axis(place, np.argsort(-p, axis=1, kind="stable").astype(np.int32), np.arange(m, dtype=np.int32)[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(COVERAGE * len(needed))) - 1)]) + 1


def widths(rows: int) -> tuple[int, int]:
    """Partitions of the first level and inside each of them, powers of two, for so many rows."""
    wanted = LEAST_PARTITIONS
    while wanted < FAN_OUT**2 and wanted * ROWS_PER_PARTITION < rows:
        wanted *= 2
    return min(wanted, FAN_OUT), max(1, wanted // FAN_OUT)


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not zero, every component a finite number."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1) if len(c) else np.empty((0, 1))


def exact_products(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of one vector with rows, added in the order of the components: alike in every block."""
    out = np.zeros(len(b))
    for d in range(b.shape[1]):
        out += q[d] * b[:, d]
    return out


def search_block(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of a block for each query; equal vectors are ranked once and then unfold by id.

    Exact products are taken of every distinct vector whose product may reach the last rank within rounding errors.
    """
    distinct, place = np.unique(x, axis=0, return_inverse=True)
    order = np.lexsort((ids, place.reshape(-1)))
    sorted_ids, ends = ids[order], np.cumsum(np.bincount(place.reshape(-1), minlength=len(distinct)))
    starts = ends - np.bincount(place.reshape(-1), minlength=len(distinct))
    # Twice what a product of doubles, added in any order, may be off by, for unit norm of the query.
    margin = 4 * (x.shape[1] + 2) * np.finfo(np.float64).eps * float(np.sqrt((distinct * distinct).sum(axis=1).max(initial=0)))
    by_id = np.sort(ids)
    own_rows = np.searchsorted(by_id, query_ids, "right") - np.searchsorted(by_id, query_ids, "left")
    first_ids = sorted_ids[starts]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(q), 256):
        s = q[a : a + 256] @ distinct.T
        for i, row in enumerate(s):
            need = k + int(own_rows[a + i])  # so many distinct vectors hold k rows of other ids
            chosen = np.arange(len(distinct))
            if need < len(distinct):
                least = np.partition(row, len(row) - need)[len(row) - need] - margin * float(np.sqrt(q[a + i] @ q[a + i]))
                chosen = np.flatnonzero(row >= least) if np.isfinite(least) else chosen
            score = exact_products(q[a + i], distinct[chosen])
            if need < len(chosen):  # of those that tie for the last rank, the smallest ids
                last = np.partition(score, len(score) - need)[len(score) - need]
                tied = np.flatnonzero(score == last)
                kept = np.concatenate([np.flatnonzero(score > last), tied[np.argsort(first_ids[chosen[tied]], kind="stable")[:need]]])
                chosen, score = chosen[kept], score[kept]
            pick = np.concatenate([sorted_ids[starts[c] : min(ends[c], starts[c] + need)] for c in chosen])
            value = np.repeat(score, np.minimum(ends[chosen] - starts[chosen], need))
            own = pick != query_ids[a + i]
            pick, value = pick[own], value[own]
            best = np.lexsort((pick, -value))[:k]
            out.append((np.full(len(best), query_ids[a + i]), pick[best], value[best]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*out))  # type: ignore[return-value]


def visited(p: np.ndarray, sizes: np.ndarray, own: list, probes: int, k: int) -> list[list[int]]:
    """The ``probes`` most probable partitions of each query, and more until they hold ``k`` rows besides its own.

    ``own`` has pairs (partition, rows with the query's id) or None for each query.
    """
    order = np.argsort(-p, axis=1, kind="stable")
    others = np.repeat(sizes[None, : p.shape[1]], len(p), axis=0)
    for i, pairs in enumerate(own):
        for part, n in pairs or ():
            others[i, part] -= n
    held = np.cumsum(np.take_along_axis(others, order, axis=1), axis=1)
    needed = np.maximum((held < k).sum(axis=1) + 1, probes)
    return [o[:c].tolist() for o, c in zip(order, needed)]


def _fit_in_one_task(sample: DataFrame, run: Callable[[np.ndarray], bytes], dim: int) -> bytes:
    """``run`` on the vectors of a bounded sample, in the order of their ids."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [matrix(b.column(0)) for b in batches if b.num_rows]
        yield pa.RecordBatch.from_arrays([pa.array([run(np.concatenate(parts)[:SAMPLE_ROWS] if parts else np.zeros((0, dim)))], pa.binary())], ["model"])

    one = sample.repartition(1).sortWithinPartitions("vec_id", "v").select("v")
    return bytes(one.mapInArrow(fit, "model binary").first()["model"])


def _inner_routers(base: DataFrame, root: Router, m: int, dim: int) -> list[Router]:
    """A network for each partition of the root, fitted to the SAMPLE_ROWS rows of the smallest hashes homed there."""
    raw = base.sparkSession.sparkContext.broadcast(Tree(root).dump())

    def homed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree.load(raw.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tree.home(matrix(b.column(1))) if b.num_rows else [], pa.int32())], ["vec_id", "v", "part"])

    def fit(rows: pa.Table) -> pa.Table:
        net = fit_router(matrix(rows.sort_by("vec_id")["v"]), m)
        return pa.table({"part": rows["part"][:1], "model": pa.array([Tree(net).dump()], pa.binary())})

    first = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(9), "vec_id"), "vec_id", "v")
    placed = base.mapInArrow(homed, "vec_id long, v array<double>, part int")
    sample = placed.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= SAMPLE_ROWS).drop("place")
    made = sample.groupBy("part").applyInArrow(fit, "part int, model binary").collect()  # at most FAN_OUT rows
    nothing = fit_router(np.zeros((0, dim)), m)
    nets = {r["part"]: Tree.load(bytes(r["model"])).root for r in made}
    return [nets.get(i, nothing) for i in range(root.w2.shape[1])]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` (vec_id, embedding) found for each row of ``queries`` (same columns).

    Nearness is the inner product in double precision; ties go to the smaller vec_id; a row never finds its own id.
    Returns query_id, rank (from 1), vec_id, score. Vectors that are null, zero, of another length than most, or
    hold null or non-finite components take no part. A query id that repeats is searched once, with its smallest
    vector; a row id that repeats is found as often as it occurs. A query goes on down its ranked partitions until they
    hold k rows of other ids: with k candidates or fewer all are returned. An empty table gives an empty result; only the
    two columns are read, so no other name can clash.
    """
    spark = vectors.sparkSession
    clean = lambda d: d.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    base, asked = clean(vectors), clean(queries)
    lengths = base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], result)
    dim, rows = lengths[0]["d"], lengths[0]["n"]
    base, asked = base.filter(F.size("v") == dim), asked.filter(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    outer, inner = widths(rows)
    sample = cut(rows_of(base, sample_keys(base, "vec_id", SAMPLE_ROWS, 9), "vec_id"))
    tree = Tree.load(_fit_in_one_task(sample, lambda x: Tree(fit_router(x, outer)).dump(), dim))
    if inner > 1:
        tree = Tree(tree.root, _inner_routers(base, tree.root, inner, dim))
    m = tree.leaves
    shared = spark.sparkContext.broadcast(tree.dump())
    probes = int(_fit_in_one_task(sample, lambda x: str(probes_needed(Tree.load(shared.value), x, k)).encode(), dim))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree.load(shared.value)
        for b in batches:
            part = tree.home(matrix(b.column(1))) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part, pa.int32())], ["vec_id", "v", "part"])

    index = cut(base.mapInArrow(home, "vec_id long, v array<double>, part int"))
    sizes = np.zeros(m, dtype=np.int64)
    for r in index.groupBy("part").agg(F.count("*").alias("n")).collect():  # at most FAN_OUT ** 2 rows
        sizes[r["part"]] = r["n"]
    own = index.join(asked.select("vec_id"), "vec_id", "left_semi").groupBy("vec_id", "part").agg(F.count("*").alias("n"))
    own = own.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("own"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree.load(shared.value)
        for b in batches:
            visits = visited(tree(matrix(b.column(1))), sizes, b.column(2).to_pylist(), probes, k) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(visits, pa.list_(pa.int32()))], ["query_id", "q", "visits"])

    known = asked.join(own, "vec_id", "left").select("vec_id", "v", "own")
    routed = cut(known.mapInArrow(route, "query_id long, q array<double>, visits array<int>")).select("query_id", "q", F.explode("visits").alias("part"))
    # One row a partition: how many blocks of rows and of queries it takes, so that no task holds more than one of each.
    loads = index.groupBy("part").agg(F.count("*").alias("n")).join(routed.groupBy("part").agg(F.count("*").alias("nq")), "part")
    loads = F.broadcast(cut(loads.select("part", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"), F.ceil(F.col("nq") / QUERY_ROWS).cast("int").alias("chunks"))))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows_in = index.join(loads, "part").select("part", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), every(F.col("chunks")).alias("chunk"), "vec_id", "v")
    asked_in = routed.join(loads, "part").select("part", every(F.col("blocks")).alias("block"), F.pmod(F.xxhash64("query_id"), "chunks").cast("int").alias("chunk"), "query_id", "q")

    def search(queries: pa.Table, block: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not queries.num_rows or not block.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        found = search_block(queries["query_id"].to_numpy(), matrix(queries["q"]), block["vec_id"].to_numpy(), matrix(block["v"]), k)
        return pa.table([pa.array(c) for c in found], names)

    groups = ["part", "block", "chunk"]
    found = asked_in.groupBy(*groups).cogroup(rows_in.groupBy(*groups)).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
