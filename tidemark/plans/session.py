"""Sessions: create tables, run an operator graph once, then bring its result up to date after each batch of changes."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.delta import DIFF, consolidate, data_columns, nullsafe, rows, signed, union
from tidemark.operators.table import KeyedTable
from tidemark.plans.frame import Frame, Rows, Sorted, Source, Stateful
from tidemark.runtime import cut, forget, plan_bytes, prepare, written_under

#: Changes of a result that are kept apart before they are merged, and the share of its base at which they join it.
FOLD_AFTER, FOLD_SHARE = 8, 0.25
#: Bytes of written keys up to which all machines hold the keys that changes name.
NAMED_BYTES = 8 << 20


class Result:
    """The output of a graph. ``df()`` always equals a run from scratch over the tables' current rows.

    Nodes with state hold their own rows. Of other graphs the rows are written once, and each step's change behind them.
    Where every row carries the key of the one table row that gives it, a change is the keys touched and their new rows:
    nothing is added up, and reading passes over what later changes name.
    """

    def __init__(self, frame: Frame):
        self.frame = frame
        frame.initialise()
        self.kept = frame.children[0] if isinstance(frame, Sorted) else frame
        self.stateful = isinstance(self.kept, Stateful)
        self.source = None if self.stateful else self.kept.keyed_by()
        self.base = None if self.stateful else cut(frame.full() if self.source else signed(frame.full()))
        self.changes: list[DataFrame] = []
        self.replaced: list[tuple[DataFrame, DataFrame]] = []
        self.steps_with_work = 0

    def _apply(self, step: int) -> None:
        change = self.frame.delta(step)
        if change is None:
            return
        self.steps_with_work += 1
        if self.stateful:
            return
        if self.source:
            self._replace(change)
            return
        self.changes.append(cut(consolidate(change)))
        if len(self.changes) > FOLD_AFTER:
            merged = cut(consolidate(union(*self.changes)))
            self.changes = [merged]
            if plan_bytes(merged) > FOLD_SHARE * plan_bytes(self.base):
                self.base, self.changes = cut(self._whole()), []

    def _replace(self, change: DataFrame) -> None:
        """Note the keys that the table's change touches and the rows they have now."""
        keys = cut(self.source.latest.select(*self.source.table.key).distinct())
        self.replaced.append((keys, cut(change.filter(f"{DIFF} > 0").drop(DIFF).select(*self.base.columns))))
        if len(self.replaced) > FOLD_AFTER:
            if sum(plan_bytes(r) for _, r in self.replaced) > FOLD_SHARE * plan_bytes(self.base):
                self.base, self.replaced = cut(self._standing(True)), []
            else:
                self.replaced = [(cut(union(*(k for k, _ in self.replaced)).distinct()), cut(self._standing(False)))]

    def _standing(self, with_base: bool) -> DataFrame:
        """Rows that no later change names the key of: of the changes, and of the base if asked for."""
        if not self.replaced:
            return self.base
        key = self.source.table.key
        named = union(*(k.withColumn("_at", F.lit(i)) for i, (k, _) in enumerate(self.replaced, 1))).groupBy(*key).agg(F.max("_at").alias("_last"))
        named = named.select(*(F.col(k).alias(f"_k_{k}") for k in key), "_last")
        if sum(plan_bytes(k) for k, _ in self.replaced) <= NAMED_BYTES:  # else the rows themselves would be shuffled
            named = F.broadcast(named)
        parts = [r.withColumn("_at", F.lit(i)) for i, (_, r) in enumerate(self.replaced, 1)]
        stacked = union(*([self.base.withColumn("_at", F.lit(0))] if with_base else []), *parts)
        kept = stacked.join(named, nullsafe(key, [f"_k_{k}" for k in key]), "left").filter(F.coalesce("_last", F.lit(0)) == F.col("_at"))
        return kept.select(*self.base.columns)

    def _whole(self) -> DataFrame:
        """The base past the rows that changes name, and those added up; a hash only tells which rows may be named."""
        if not self.changes:
            return self.base
        changes = union(*self.changes)
        hashed = F.xxhash64(*(c for c in data_columns(self.base) if not self.base.schema[c].dataType.simpleString().startswith("map")), F.lit(0))
        named = changes.select(hashed.alias("_named")).distinct()
        marked = self.base.withColumn("_hash", hashed)
        untouched = marked.join(named, F.col("_hash") == F.col("_named"), "left_anti").drop("_hash")
        touched = marked.join(named, F.col("_hash") == F.col("_named"), "left_semi").drop("_hash")
        return untouched.unionByName(consolidate(touched.unionByName(changes)))

    def df(self) -> DataFrame:
        out = self.kept.full() if self.stateful else self._standing(True) if self.source else rows(self._whole())
        return self.frame.ranked(out) if isinstance(self.frame, Sorted) else out

    def collect(self) -> list:
        """All rows, on the driver: for small results."""
        return self.df().collect()


class Session:
    """Tables and the graphs over them. What a session writes lies in a folder of its own; ``close`` deletes it."""

    def __init__(self, spark: SparkSession):
        self.spark = prepare(spark)
        self.folder = f"session-{uuid.uuid4().hex}"
        self.sources: dict[str, Source] = {}
        self.results: list[Result] = []
        self._known: dict[str, tuple[Frame, Result]] = {}
        self.step = 0

    def create_table(self, name: str, key: list[str] | str, initial: DataFrame, defaults: dict[str, object] | None = None, trusted: bool = False) -> KeyedTable:
        """A table of rows with unique keys: a key that repeats raises ValueError, unless the rows are ``trusted``."""
        with written_under(self.folder):
            table = KeyedTable(self.spark, name, key, initial, defaults, trusted)
        self.sources[name] = Source(table)
        return table

    def create_scalar(self, name: str, value: object, kind: str) -> KeyedTable:
        """A single updatable value: a table of one row, key 0."""
        return self.create_table(name, "id", self.spark.createDataFrame([(0, value)], f"id int, value {kind}"))

    def frame(self, table: KeyedTable | str) -> Frame:
        return self.sources[table if isinstance(table, str) else table.name]

    def rows(self, df: DataFrame) -> Frame:
        """Rows without keys that never change."""
        return Rows(df)

    def run(self, frame: Frame) -> Result:
        """Compute a graph once. A graph that does the same on the same tables gives the same result object."""
        known = frame.fingerprint()
        if known not in self._known:
            with written_under(self.folder):
                self._known[known] = (frame, Result(frame))  # the frame stays, so its fingerprint stays its own
            self.results.append(self._known[known][1])
        return self._known[known][1]

    def run_all(self, *frames: Frame) -> list[Result]:
        """Run independent graphs at the same time, their jobs side by side."""
        shared = [n for n in {id(n): n for f in frames for n in f.nodes()}.values()]
        with written_under(self.folder):
            for node in shared:  # state that graphs share is built once, before they part
                node.initialise()
        with ThreadPoolExecutor(max_workers=max(1, len(frames))) as pool:
            return list(pool.map(self.run, frames))

    def propagate(self) -> int:
        """Apply all queued changes and update every result; returns how many tables changed. Nothing queued, no work."""
        if not any(s.table.pending for s in self.sources.values()):
            return 0
        self.step += 1
        changed = 0
        with written_under(self.folder):
            for s in self.sources.values():
                s.latest = s.table.advance()
                changed += s.latest is not None
            if changed:
                for r in self.results:
                    r._apply(self.step)
        return changed

    def dot(self) -> str:
        """The operator graph of all results for Graphviz."""
        nodes = {id(n): n for r in self.results for n in r.frame.nodes()}
        names = {k: f"n{i}" for i, k in enumerate(nodes)}
        lines = [f'  {names[k]} [label="{n.describe()}"];' for k, n in nodes.items()]
        lines += [f"  {names[id(c)]} -> {names[k]};" for k, n in nodes.items() for c in n.children]
        return "\n".join(["digraph tidemark {", *lines, "}"])

    def close(self) -> None:
        """Drop all tables and results and delete what they wrote."""
        forget(self.spark, self.folder)
        self.sources.clear()
        self.results.clear()
        self._known.clear()


__all__ = ["Result", "Session"]
