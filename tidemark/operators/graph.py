"""Graphs as edge tables: adjacency, degrees, and PageRank in full or brought up to date from changed edges.

PageRank starts from 1.0 everywhere; a step gives each node 0.15 and 0.85 of its in-neighbours' ranks, each divided by
the neighbour's number of edges. Nodes without edges out pass nothing on, repeated edges count, every node is ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.delta import DIFF, nullsafe, union
from tidemark.operators.store import NEW, OLD, KeyedStore, change_of, packed
from tidemark.plans.frame import Frame, Stateful
from tidemark.runtime import cut

BASE, DAMPING = 0.15, 0.85


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, neighbours): sorted targets of each node, an empty array for nodes without edges out."""
    out = edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))
    kind = out.schema["neighbours"].dataType.simpleString()
    return nodes_of(edges).join(out, F.col("node") == F.col("src"), "left").select("node", F.coalesce("neighbours", F.array().cast(kind)).alias("neighbours"))


def out_degree(edges: DataFrame) -> DataFrame:
    deg = edges.groupBy("src").agg(F.count("*").alias("deg"))
    return nodes_of(edges).join(deg, F.col("node") == F.col("src"), "left").select("node", F.coalesce("deg", F.lit(0)).cast("long").alias("out_degree"))


def in_neighbours(edges: DataFrame) -> DataFrame:
    """(node, out_degree, neighbours): the reverse graph, each node with its own number of edges out."""
    reverse = adjacency(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return reverse.join(out_degree(edges), "node").select("node", "out_degree", "neighbours")


def _weighted(edges: DataFrame) -> DataFrame:
    """Edges grouped by source with the share of a source's rank that each passes on."""
    deg = edges.groupBy("src").agg(F.count("*").alias("deg"))
    once = edges.groupBy("src", "dst").agg(F.count("*").alias("m"))
    return once.join(deg, "src").select("src", "dst", (DAMPING * F.col("m") / F.col("deg")).alias("w"))


def _next(weighted: DataFrame, nodes: DataFrame, ranks: DataFrame) -> DataFrame:
    passed = weighted.join(ranks, weighted["src"] == ranks["node"]).select(F.col("dst").alias("node"), (F.col("rank") * F.col("w")).alias("r"))
    return nodes.select("node", F.lit(BASE).alias("r")).unionByName(passed).groupBy("node").agg(F.sum("r").alias("rank"))


def pagerank(edges: DataFrame, steps: int) -> DataFrame:
    """(node, rank) after ``steps`` steps, as one plan. Edges are grouped by source once; each step joins ranks to
    them and adds up by target before anything is shuffled."""
    weighted, nodes = _weighted(edges), nodes_of(edges)
    ranks = nodes.select("node", F.lit(1.0).alias("rank"))
    for _ in range(steps):
        ranks = _next(weighted, nodes, ranks)
    return ranks


def pagerank_steps(edges: DataFrame, steps: int) -> list[DataFrame]:
    """The ranks before the first step and after each, every one written and made from the one before."""
    weighted, nodes = cut(_weighted(edges)), cut(nodes_of(edges))
    ranks = [nodes.select("node", F.lit(1.0).alias("rank"))]
    for _ in range(steps):
        ranks.append(cut(_next(weighted, nodes, ranks[-1])))
    return ranks


def reverse_pagerank(edges: DataFrame, steps: int) -> DataFrame:
    """The same ranks pulled along in-edges: each node gathers from its in-neighbours, listed with their degrees."""
    deg = edges.groupBy("src").agg(F.count("*").alias("deg"))
    pulled = edges.join(deg, "src").select(F.col("dst").alias("to"), F.col("src").alias("from"), "deg").repartition("from")
    nodes = nodes_of(edges)
    ranks = nodes.select("node", F.lit(1.0).alias("rank"))
    for _ in range(steps):
        got = pulled.join(ranks, F.col("from") == F.col("node")).groupBy("to").agg(F.sum(DAMPING * F.col("rank") / F.col("deg")).alias("got"))
        ranks = nodes.join(got, F.col("node") == F.col("to"), "left").select("node", (BASE + F.coalesce("got", F.lit(0.0))).alias("rank"))
    return ranks


def column_pagerank(edges: DataFrame, steps: int) -> DataFrame:
    """A wide table: node and its rank after each step, rank_1 to rank_<steps>."""
    out, *after = pagerank_steps(edges, steps)
    out = out.select("node")
    for i, ranks in enumerate(after, 1):
        out = out.join(ranks.withColumnRenamed("rank", f"rank_{i}"), "node")
    return out


class PageRank(Stateful):
    """Ranks of the edges (src, dst) of a frame, maintained.

    State are the edges with their multiplicity, by source, and one row a node: its edges out, its presence ``n`` (ends
    of edges that lie there) and its rank after every step. A change touches, step by step, the sources whose rank or
    edges changed: their edges are read, and what they pass on now less what they passed on before is added to the ranks
    of the nodes they point to. Nothing is done for the others. When most of the graph changes, that costs about twice
    a run from scratch. Changes no larger than ``epsilon`` aren't passed on.
    """

    op = "pagerank"

    def __init__(self, edges: Frame, steps: int, epsilon: float = 0.0):
        super().__init__(edges)
        self.steps, self.epsilon = steps, epsilon
        self.ranks = [f"r{i}" for i in range(1, steps + 1)]
        self.edges: KeyedStore | None = None

    def _does(self):
        return repr((self.steps, self.epsilon))

    def _shown(self, nodes: DataFrame) -> DataFrame:
        return nodes.select("node", F.col(self.ranks[-1]).alias("rank"))

    def full(self, version="new"):
        if self.store:
            return self._shown(self.store.rows(version))
        return pagerank(self.children[0].full(version).select("src", "dst"), self.steps)

    def at(self, keys, on, version="new"):
        return self._shown(self.store.lookup(keys, on, version)) if self.store and on == ["node"] else super().at(keys, on, version)

    def _build(self):
        edges = self.children[0].full().select("src", "dst")
        self.edges = KeyedStore(edges.groupBy("src", "dst").agg(F.count("*").alias("m")), ["src", "dst"], ["src"])
        known = self.edges.rows()
        weighted = cut(known.join(known.groupBy("src").agg(F.sum("m").alias("deg")), "src").select("src", "dst", (DAMPING * F.col("m") / F.col("deg")).alias("w")))
        ends = known.select(F.col("src").alias("node"), F.col("m").alias("deg"), F.col("m").alias("n")).unionByName(known.select(F.col("dst").alias("node"), F.lit(0).cast("long").alias("deg"), F.col("m").alias("n")))
        nodes = cut(ends.groupBy("node").agg(F.sum("deg").alias("deg"), F.sum("n").alias("n")))
        last = nodes.select("node", F.lit(1.0).alias("rank"))
        out = nodes
        for r in self.ranks:
            last = cut(_next(weighted, nodes, last))
            out = out.join(last.withColumnRenamed("rank", r), "node")
        return KeyedStore(out.select("node", "deg", "n", *self.ranks), ["node"])

    def _change(self, changes, step):
        edges, store = self.edges, self.store
        moved = cut(changes[0].groupBy("src", "dst").agg(F.sum(DIFF).alias("d")).filter("d <> 0"))
        kept = edges.lookup(moved, ["src", "dst"]).selectExpr("src as e_src", "dst as e_dst", "m")
        both = moved.join(kept, nullsafe(["src", "dst"], ["e_src", "e_dst"]), "left").selectExpr("src", "dst", "m", "cast(coalesce(m, 0) + d as long) as m_new")
        links = edges.apply(cut(both.selectExpr("src", "dst", f"if(m > 0, struct(true as _here, m), null) as {OLD}", f"if(m_new > 0, struct(true as _here, m_new as m), null) as {NEW}")))
        if links is None:
            return None
        # What lies beside a node before this change; where the store is one folder it is planned once for all steps.
        former = lambda rows: rows.select(F.col("node").alias("k"), packed(store.values).alias(OLD))
        everything = former(store.rows()) if store.buckets == 1 else None

        def with_old(nodes: DataFrame) -> DataFrame:
            if everything is not None:
                return nodes.join(everything, F.col("node") == F.col("k"), "left")
            nodes = cut(nodes)
            return nodes.join(former(store.lookup(nodes, ["node"])), F.col("node") == F.col("k"), "left")

        # Nodes whose edges changed: their new number of edges out and their presence. The ranks come later.
        ends = moved.selectExpr("inline(array(struct(src as node, d as d_deg, d as d_n), struct(dst as node, 0L as d_deg, d as d_n)))").groupBy("node").agg(F.sum("d_deg").alias("d_deg"), F.sum("d_n").alias("d_n"))
        born = cut(with_old(ends).selectExpr("node", OLD, f"cast(coalesce({OLD}.deg, 0) + d_deg as long) as deg", f"cast(coalesce({OLD}.n, 0) + d_n as long) as n"))
        asked = born.selectExpr("node", "0D as d", "true as must")
        counts = born.selectExpr("node as b_node", "deg", "n")
        relinked = links.selectExpr("src", "dst", f"coalesce({NEW}.m, 0) - coalesce({OLD}.m, 0) as dm")
        former_edges = edges.rows("old") if edges.buckets == 1 else None
        # (node, _old, deg, n, rank) of the nodes whose edges or whose rank after a step changed; at first ranks are 1.
        acting, moves = born.withColumn("rank", F.lit(1.0)), []
        for i in range(1, self.steps + 1):
            was = f"{OLD}.r{i - 1}" if i > 1 else "1D"
            passing = acting.selectExpr(
                "node as src",
                f"coalesce(if({OLD}.deg > 0, {DAMPING} * {was} / {OLD}.deg, 0D), 0D) as w_old",
                f"coalesce(if(coalesce(n, {OLD}.n) > 0 and coalesce(deg, {OLD}.deg) > 0, {DAMPING} * rank / coalesce(deg, {OLD}.deg), 0D), 0D) as w_new",
            )
            reached = edges.lookup(acting.selectExpr("node as src"), ["src"], "old") if former_edges is None else former_edges
            told = reached.join(passing, "src").selectExpr("dst as node", "m * (w_new - w_old) as d", "false as must")
            told = told.unionByName(relinked.join(passing, "src").selectExpr("dst as node", "dm * w_new as d", "false as must")).unionByName(asked)
            touched = told.groupBy("node").agg(F.sum("d").alias("d"), F.bool_or("must").alias("must")).filter((F.abs("d") > self.epsilon) | F.col("must"))
            acting = cut(with_old(touched).join(counts, F.col("node") == F.col("b_node"), "left").selectExpr("node", OLD, "deg", "n", f"coalesce({OLD}.r{i}, {BASE}D) + d as rank"))
            moves.append(acting)
        return self._settle(moves)

    def _settle(self, moves: list[DataFrame]) -> DataFrame | None:
        """Write the new rows of all nodes that any step touched, and give the change of the ranks."""
        values = self.store.values
        parts = [m.selectExpr("node", OLD, "deg", "n", *(f"{'rank' if j == i else 'cast(null as double)'} as {r}" for j, r in enumerate(self.ranks))) for i, m in enumerate(moves)]
        merged = union(*parts).groupBy("node").agg(F.first(OLD, ignorenulls=True).alias(OLD), *(F.max(c).alias(c) for c in values))
        filled = merged.selectExpr("node", OLD, *(f"coalesce({c}, {OLD}.{c}) as {c}" for c in values))
        step = self.store.apply(cut(filled.select("node", OLD, F.when(F.col("n") > 0, packed(values)).alias(NEW)).filter(f"{OLD} is not null or {NEW} is not null")))
        if step is None:
            return None
        shown = lambda x: F.when(F.col(x).isNotNull(), F.struct(F.lit(True).alias("_here"), F.col(f"{x}.{self.ranks[-1]}").alias("rank"))).alias(x)
        return change_of(step.select("node", shown(OLD), shown(NEW)), ["node"], ["rank"])
