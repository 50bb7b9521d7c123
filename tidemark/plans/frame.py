"""Operator graphs over keyed tables.

Every node can build its full result as one DataFrame plan (``full``) and the change of its result as another
(``delta``), from the changes of its inputs. Both are ordinary plans that Catalyst optimises; nothing is traced per
row. ``full("old")`` is the result over the versions before the last step, and ``at`` the part of a result under
some keys, which joins and recomputed groups need: where a table or a reduction is keyed by them, only the folders of its
state that hold these keys are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.agg import AggSpec
from tidemark.operators.delta import DIFF, data_columns, negate, nullsafe, restrict, signed, union
from tidemark.operators.store import NEW, OLD, KeyedStore, change_of, packed
from tidemark.operators.table import KeyedTable
from tidemark.runtime import cut, spread

#: Hash buckets of a global reduction without inverse: a change recomputes the buckets it touches.
BUCKETS = 64


def _text(*exprs: Column | str) -> str:
    """What tells expressions apart: the text of a string, the object itself of a column."""
    return repr([e if isinstance(e, str) else f"column@{id(e)}" for e in exprs])


class Frame:
    """A node of the graph. Build graphs with the methods; run them with a ``Session``."""

    op = "frame"

    def __init__(self, *children: Frame):
        self.children = children
        self._step: tuple[int, DataFrame | None] = (-1, None)

    # -- to override --------------------------------------------------------------------------------------------

    def full(self, version: str = "new") -> DataFrame:
        raise NotImplementedError

    def _change(self, changes: list[DataFrame | None], step: int) -> DataFrame | None:
        raise NotImplementedError

    def at(self, keys: DataFrame, on: list[str], version: str = "new") -> DataFrame:
        """Rows of ``full`` whose columns ``on`` are among those of the written table ``keys``."""
        return restrict(self.full(version), keys, on)

    # -- shared -------------------------------------------------------------------------------------------------

    def delta(self, step: int) -> DataFrame | None:
        """Change of this node in a step; computed once a step, None if no input changed."""
        if self._step[0] != step:
            changes = [c.delta(step) for c in self.children]
            self._step = (step, None if all(c is None for c in changes) and self.children else self._change(changes, step))
        return self._step[1]

    def initialise(self) -> None:
        """Build whatever state the node keeps, children first."""
        for c in self.children:
            c.initialise()

    def nodes(self) -> list[Frame]:
        seen: dict[int, Frame] = {}
        for c in self.children:
            seen |= {id(n): n for n in c.nodes()}
        return [*seen.values(), self]

    def describe(self) -> str:
        return self.op

    def fingerprint(self) -> str:
        """The same for graphs that do the same on the same tables; of a node that can't tell, its own."""
        mine = self._does()
        return f"{type(self).__name__}@{id(self)}" if mine is None else f"{type(self).__name__}({mine}; {', '.join(c.fingerprint() for c in self.children)})"

    def _does(self) -> str | None:
        return None

    def keyed_by(self) -> Source | None:
        """The one table of which each row gives its own rows here, all with that row's key; None if it isn't so."""
        return None

    # -- operators ----------------------------------------------------------------------------------------------

    def map(self, *exprs: Column | str) -> Frame:
        """One row per row; keys may change and needn't be unique."""
        return Linear(self, "map", lambda d: [*(F.expr(e) if isinstance(e, str) else e for e in exprs)], does=_text(*exprs))

    def map_values(self, **exprs: str) -> Frame:
        """Replace value columns; the other columns, the key among them, stay."""
        kept = lambda on: not set(on) & set(exprs)
        return Linear(self, "map_values", lambda d: [*(F.expr(exprs[c]).alias(c) if c in exprs else F.col(c) for c in d), *(F.expr(e).alias(c) for c, e in exprs.items() if c not in d)], kept, repr(exprs))

    def flat_map(self, array: Column | str, *keep: str) -> Frame:
        """0..n rows per row: one for each struct of an array, its fields as columns, beside the columns ``keep``."""
        return FlatMap(self, F.expr(array) if isinstance(array, str) else array, keep, _text(array))

    def filter(self, predicate: Column | str) -> Frame:
        return Filter(self, F.expr(predicate) if isinstance(predicate, str) else predicate, _text(predicate))

    def split(self, predicate: Column | str) -> tuple[Frame, Frame]:
        """Rows that satisfy the predicate, and all others (null counts as not satisfied)."""
        p = F.coalesce(F.expr(predicate) if isinstance(predicate, str) else predicate, F.lit(False))
        return Filter(self, p, f"true {_text(predicate)}"), Filter(self, ~p, f"false {_text(predicate)}")

    def project(self, *columns: str) -> Frame:
        return Linear(self, "project", lambda d: [F.col(c) for c in columns], lambda on: True, repr(columns))

    def spread(self, *by: str) -> Frame:
        """The same rows; in full runs placed by ``by``, in parts of bounded size, so that rows made of them (words of a
        text) are grouped where they arise, without a shuffle of their own."""
        return Spread(self, by)

    def join(self, other: Frame, on: list[str] | str, residual: str | None = None, hint: str | None = None) -> Frame:
        """Inner join on equal keys, with a residual condition; ``hint="merge"`` asks for a sort join."""
        return Join(self, other, [on] if isinstance(on, str) else on, residual, hint)

    def semi_join(self, other: Frame, on: list[str] | str) -> Frame:
        """Rows whose key is in ``other``."""
        keys = [on] if isinstance(on, str) else on
        return Join(self, other.distinct(*keys), keys, None, None)

    def get(self, keys: Frame, on: list[str] | str) -> Frame:
        """Rows under the keys that another graph gives; a key that it gives twice counts once."""
        cols = [on] if isinstance(on, str) else on
        return Join(keys.distinct(*cols), self, cols, None, None)

    def distinct(self, *columns: str) -> Frame:
        return Reduce(self, list(columns), [], "distinct")

    def reduce_by_key(self, key: list[str] | str, *specs: AggSpec, drop_initial: str | None = None, threshold: float | None = None) -> Frame:
        return Reduce(self, [key] if isinstance(key, str) else key, list(specs), "reduce_by_key", drop_initial, threshold)

    def reduce_by(self, canonical: str, name: str, *specs: AggSpec) -> Frame:
        """Reduce rows that a comparator holds equal; the comparator is an expression that they agree in."""
        return Reduce(self.map_values(**{name: canonical}), [name], list(specs), "reduce_by")

    def reduce(self, *specs: AggSpec, key: str | None = None) -> Frame:
        """Reduce everything to one row; no row if there is none. Without an inverse, partial results per bucket of ``key``."""
        if all(s.invertible for s in specs) or key is None:
            return Reduce(self, [], list(specs), "reduce")
        bucketed = self.map_values(_bucket=f"pmod(xxhash64({key}), {BUCKETS})")
        partial = Reduce(bucketed, ["_bucket"], list(specs), "bucket")
        return Reduce(partial, [], [AggSpec(s.name, s.kind, s.name) if s.kind in ("min", "max", "sum") else s for s in specs], "reduce")

    def chunk_map(self, chunk: str, *specs: AggSpec) -> Frame:
        """One row per chunk, a chunk being an expression of the key; touched chunks are computed anew."""
        return Reduce(self.map_values(chunk_id=chunk), ["chunk_id"], list(specs), "chunk_map")

    def for_each_chunk(self, chunk: str, sinks: dict[str, list[AggSpec]]) -> dict[str, Frame]:
        """Several sinks fed from the same chunks: for each a frame of one row per chunk."""
        chunked = self.map_values(chunk_id=chunk)
        return {name: Reduce(chunked, ["chunk_id"], list(specs), f"for_each_chunk {name}") for name, specs in sinks.items()}

    def aggregate_into(self, key: list[str] | str, *specs: AggSpec, threshold: float | None = None, drop_initial: str | None = None) -> Frame:
        """Keyed aggregate sink. ``threshold`` leaves out deltas of at most that size, ``drop_initial`` names a column whose zero deletes the key."""
        return Reduce(self, [key] if isinstance(key, str) else key, list(specs), "aggregate_into", drop_initial, threshold)

    def merge(self, other: Frame) -> Frame:
        """Rows of both, columns by name; ``ranked`` shows them in one order."""
        return Union(self, other)

    def mergesort(self, *order: str) -> Sorted:
        """Rows with their rank in an order; ranks are computed when read."""
        return Sorted(self, order)


class Source(Frame):
    op = "table"

    def __init__(self, table: KeyedTable):
        super().__init__()
        self.table, self.latest = table, None

    def _does(self):
        return f"{self.table.name}@{id(self.table)}"

    def keyed_by(self):
        return self

    def full(self, version: str = "new") -> DataFrame:
        return self.table.df(version)

    def at(self, keys, on, version="new"):
        return self.table.store.lookup(keys, on, version) if set(on) <= set(self.table.key) else super().at(keys, on, version)

    def _change(self, changes, step):
        return self.latest

    def describe(self) -> str:
        return f"table {self.table.name}"


class Rows(Frame):
    """Rows without keys that never change, for running graphs in full or joining them."""

    op = "rows"

    def __init__(self, df: DataFrame):
        super().__init__()
        self.df = df

    def full(self, version="new"):
        return self.df

    def delta(self, step):
        return None


class Linear(Frame):
    """One row per row; ``kept`` tells whether some columns pass unchanged under their names."""

    def __init__(self, child: Frame, op: str, exprs, kept=lambda on: False, does: str | None = None):
        super().__init__(child)
        self.op, self.exprs, self.kept, self.does = op, exprs, kept, does

    def _does(self):
        return None if self.does is None else f"{self.op} {self.does}"

    def keyed_by(self):
        source = self.children[0].keyed_by()
        return source if source and self.kept(source.table.key) and set(source.table.key) <= set(self.full().columns) else None

    def at(self, keys, on, version="new"):
        if not self.kept(on):
            return super().at(keys, on, version)
        d = self.children[0].at(keys, on, version)
        return d.select(*self.exprs(d.columns))

    def full(self, version="new"):
        d = self.children[0].full(version)
        return d.select(*self.exprs(d.columns))

    def _change(self, changes, step):
        d = changes[0]
        return d.select(*self.exprs(data_columns(d)), DIFF)


class Spread(Frame):
    """Rows as they are; only where they lie differs."""

    op = "spread"

    def __init__(self, child: Frame, by: tuple[str, ...]):
        super().__init__(child)
        self.by = by

    def _does(self):
        return repr(self.by)

    def keyed_by(self):
        return self.children[0].keyed_by()

    def full(self, version="new"):
        return spread(self.children[0].full(version), *self.by)

    def at(self, keys, on, version="new"):
        return self.children[0].at(keys, on, version)

    def _change(self, changes, step):
        return changes[0]


class FlatMap(Frame):
    op = "flat_map"

    def __init__(self, child: Frame, array: Column, keep: tuple[str, ...], does: str | None = None):
        super().__init__(child)
        self.array, self.keep, self.does = array, keep, does

    def _does(self):
        return None if self.does is None else f"{self.does} {self.keep}"

    def keyed_by(self):
        source = self.children[0].keyed_by()
        return source if source and set(source.table.key) <= set(self.keep) else None

    def _apply(self, d: DataFrame, *more: str) -> DataFrame:
        return d.select(*self.keep, *more, F.inline(self.array))

    def full(self, version="new"):
        return self._apply(self.children[0].full(version))

    def _change(self, changes, step):
        return self._apply(changes[0], DIFF)


class Filter(Frame):
    op = "filter"

    def __init__(self, child: Frame, predicate: Column, does: str | None = None):
        super().__init__(child)
        self.predicate, self.does = predicate, does

    def _does(self):
        return self.does

    def keyed_by(self):
        return self.children[0].keyed_by()

    def full(self, version="new"):
        return self.children[0].full(version).filter(self.predicate)

    def at(self, keys, on, version="new"):
        return self.children[0].at(keys, on, version).filter(self.predicate)

    def _change(self, changes, step):
        return changes[0].filter(self.predicate)


class Union(Frame):
    op = "merge"

    def _does(self):
        return ""

    def full(self, version="new"):
        a, b = (c.full(version) for c in self.children)
        return a.unionByName(b)

    def at(self, keys, on, version="new"):
        a, b = (c.at(keys, on, version) for c in self.children)
        return a.unionByName(b)

    def _change(self, changes, step):
        return union(*changes)


class Sorted(Frame):
    """Content changes pass through; the rank is a window over what is read."""

    op = "mergesort"

    def __init__(self, child: Frame, order: tuple[str, ...]):
        super().__init__(child)
        self.names = order
        self.order = [F.expr(o.removesuffix(" desc")).desc() if o.endswith(" desc") else F.expr(o).asc() for o in order]

    def full(self, version="new"):
        return self.children[0].full(version)

    def _change(self, changes, step):
        return changes[0]

    def _does(self):
        return repr(self.names)

    def ranked(self, rows: DataFrame | None = None, name: str = "rank") -> DataFrame:
        """Global ranks without one task seeing all rows: rank inside ranges of the order, plus the rows before each range."""
        return global_rank(self.full() if rows is None else rows, self.order, name)


def global_rank(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``row_number`` over everything: a range-partitioned sort, ranks inside partitions, and an offset per partition."""
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy(*order)
    ranked = placed.withColumn("_within", F.row_number().over(within)).join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
    return ranked.withColumn(name, (F.col("_within") + F.col("_before")).cast("long")).drop("_part", "_p", "_before", "_within")


class Join(Frame):
    op = "join"

    def __init__(self, left: Frame, right: Frame, on: list[str], residual: str | None, hint: str | None):
        super().__init__(left, right)
        self.on, self.residual, self.hint = on, residual, hint

    def _does(self):
        return repr((self.on, self.residual, self.hint))

    def _join(self, a: DataFrame, b: DataFrame) -> DataFrame:
        out = a.join(b.hint(self.hint) if self.hint else b, self.on)
        return out.filter(F.expr(self.residual)) if self.residual else out

    def full(self, version="new"):
        return self._join(self.children[0].full(version), self.children[1].full(version))

    def _change(self, changes, step):
        da, db = changes
        a, b = self.children
        second = lambda d: d.withColumnRenamed(DIFF, "_diff2")
        times = lambda d: d.withColumn(DIFF, F.col(DIFF) * F.col("_diff2")).drop("_diff2")
        # Each change is written once, and the other side is read under its keys only.
        parts = []
        if da is not None:
            da = cut(da)
            parts.append(times(self._join(da, second(signed(b.at(da, self.on, "new"))))))
        if db is not None:
            db = cut(db)
            parts.append(times(self._join(signed(a.at(db, self.on, "old")), second(db))))
        return union(*parts)


class Stateful(Frame):
    """A node whose result is kept, by key, in a store of its own.

    What is taken back is read from what was kept: sums of floating-point numbers computed again may differ in their
    last bits, and such a row would never cancel.
    """

    def __init__(self, *children: Frame):
        super().__init__(*children)
        self.store: KeyedStore | None = None

    def _build(self) -> KeyedStore:
        raise NotImplementedError

    def initialise(self) -> None:
        super().initialise()
        if self.store is None:
            self.store = self._build()

    def delta(self, step):
        if self.store is not None and self._step[0] != step:
            self.store.before = (self.store.base, list(self.store.steps))
        return super().delta(step)


class Reduce(Stateful):
    """Keyed or global reduction.

    Aggregates with an inverse keep their partial sums and a row count per group: a change adds the sums of its own
    rows to those of the groups it touches, and a group is there while its count is above zero. Others keep their
    values, and compute those of touched groups anew.
    """

    def __init__(self, child: Frame, keys: list[str], specs: list[AggSpec], op: str, drop_initial: str | None = None, threshold: float | None = None):
        super().__init__(child)
        self.keys, self.specs, self.op = keys, specs, op
        self.drop_initial, self.threshold = drop_initial, threshold
        self.additive = all(s.invertible for s in specs)

    def _does(self):
        return repr((self.keys, self.specs, self.drop_initial, self.threshold))

    def _guard(self, d: DataFrame) -> DataFrame:
        """Deltas too small to count; judged on each row's value, so that partitioning can't change a result."""
        if self.threshold is None:
            return d
        return d.filter(F.abs(F.expr(self.specs[0].value)) > self.threshold)

    def _grouped(self, d: DataFrame) -> DataFrame:
        grouped = self._guard(d).groupBy(*self.keys).agg(*(s.full() for s in self.specs), F.count(F.lit(1)).alias("_rows")).filter("_rows > 0").drop("_rows")
        return grouped.filter(f"{self.drop_initial} <> 0") if self.drop_initial else grouped

    def _sums(self, d: DataFrame) -> DataFrame:
        if any(s.kind == "group" for s in self.specs):  # a group's operation takes one value at a time
            d = d.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.abs(DIFF)))).drop("_n").withColumn(DIFF, F.signum(DIFF).cast("long"))
        return d.groupBy(*self.keys).agg(F.sum(DIFF).alias("_rows"), *(p for s in self.specs for p in s.partials(F.col(DIFF))))

    def _present(self, prefix: str) -> Column:
        there = F.col(f"{prefix}_rows") > 0
        for s in self.specs:
            if s.name == self.drop_initial:
                there = there & (s.value_of(prefix) != 0)
        return there

    def _outputs(self, prefix: str = "") -> list[Column]:
        return [s.value_of(prefix).alias(s.name) for s in self.specs]

    def _shown(self, kept: DataFrame) -> DataFrame:
        return kept.filter(self._present("")).select(*self.keys, *self._outputs()) if self.additive else kept

    def full(self, version="new"):
        return self._shown(self.store.rows(version)) if self.store else self._grouped(self.children[0].full(version))

    def at(self, keys, on, version="new"):
        if self.store is None or not set(on) <= set(self.keys):
            return super().at(keys, on, version)
        return self._shown(self.store.lookup(keys, on, version))

    def _build(self):
        child = self.children[0].full()
        return KeyedStore(self._sums(signed(self._guard(child))).filter("_rows > 0") if self.additive else self._grouped(child), self.keys)

    def _change(self, changes, step):
        return self._added(self._guard(changes[0])) if self.additive else self._anew(self._guard(changes[0]))

    def _added(self, d: DataFrame) -> DataFrame | None:
        added = cut(self._sums(d))
        store = self.store
        step = store.apply(cut(self._together(added).filter(f"{OLD} is not null or {NEW} is not null")))
        if step is None:
            return None
        side = lambda x: F.when(self._present(f"{x}."), F.struct(F.lit(True).alias("_here"), *self._outputs(f"{x}."))).alias(x)
        return change_of(step.select(*self.keys, side(OLD), side(NEW)), self.keys, [s.name for s in self.specs])

    def _together(self, added: DataFrame) -> DataFrame:
        """(keys, _old, _new): kept sums of the groups touched, and what they are with the added ones."""
        values, kinds = self.store.values, dict(self.store.base.dtypes)
        if self.keys and not any(s.kind == "group" for s in self.specs):
            sums = self.store.met(added).select(*self.keys, OLD, *(F.expr(f"cast(coalesce(`{c}`, 0) + coalesce({OLD}.`{c}`, 0) as {kinds[c]}) as `{c}`") for c in values))
        else:
            known = self.store.lookup(added, self.keys)
            both = known.withColumn(OLD, packed(values)).unionByName(added, allowMissingColumns=True).groupBy(*self.keys)
            sums = both.agg(F.sum("_rows").alias("_rows"), *(p for s in self.specs for p in s.merged()), F.first(OLD, ignorenulls=True).alias(OLD))
            sums = sums.withColumns({c: F.col(c).cast(kinds[c]) for c in values})
        return sums.select(*self.keys, OLD, F.when(F.col("_rows") > 0, packed(values)).alias(NEW))

    def _anew(self, d: DataFrame) -> DataFrame | None:
        touched = cut(d.select(*self.keys).distinct()) if self.keys else d
        store = self.store
        new = self._grouped(self.children[0].at(touched, self.keys))
        old = store.lookup(touched, self.keys)
        stacked = old.select(*self.keys, packed(store.values).alias(OLD)).unionByName(new.select(*self.keys, packed(store.values).alias(NEW)), allowMissingColumns=True)
        step = stacked.groupBy(*self.keys).agg(F.first(OLD, ignorenulls=True).alias(OLD), F.first(NEW, ignorenulls=True).alias(NEW))
        step = store.apply(cut(step.filter(~F.col(OLD).eqNullSafe(F.col(NEW)))))
        return None if step is None else change_of(step, self.keys, store.values)


class Wide(Stateful):
    """One row a key from several frames, each of which gives one column; what a frame lacks has its default.

    Beside each row is kept which frames have its key, so that a change of frames with state needs only what they changed
    and the rows kept here. Of other frames, whose changes may name a row more than once, the touched keys are looked up.
    """

    op = "wide"
    THERE = "_in_"

    def __init__(self, key: str, columns: dict[str, Frame], defaults: dict[str, object]):
        super().__init__(*columns.values())
        self.key, self.names, self.defaults = key, list(columns), defaults

    def _row(self, parts: list[DataFrame]) -> DataFrame:
        from tidemark.operators.wide import merge_columns

        return merge_columns(self.key, {n: d.select(self.key, n) for n, d in zip(self.names, parts)}, self.defaults, self.THERE)

    def full(self, version="new"):
        rows = self.store.rows(version) if self.store else self._row([c.full(version) for c in self.children])
        return rows.select(self.key, *self.names)

    def at(self, keys, on, version="new"):
        return self.store.lookup(keys, on, version).select(self.key, *self.names) if self.store and on == [self.key] else super().at(keys, on, version)

    def _build(self):
        return KeyedStore(self._row([c.full() for c in self.children]), [self.key])

    def _change(self, changes, step):
        known = all(isinstance(c, Stateful) for c in self.children)
        made = self._moved(changes) if known else self._anew(changes)
        step = self.store.apply(cut(made.filter(~F.col(OLD).eqNullSafe(F.col(NEW)))))
        if step is None:
            return None
        side = lambda x: F.when(F.col(x).isNotNull(), F.struct(F.lit(True).alias("_here"), *(F.col(f"{x}.{n}").alias(n) for n in self.names))).alias(x)
        return change_of(step.select(self.key, side(OLD), side(NEW)), [self.key], self.names)

    def _moved(self, changes: list[DataFrame | None]) -> DataFrame:
        """(key, _old, _new) from the changes alone: of each key and frame at most one row goes and one comes."""
        kinds = dict(self.store.base.dtypes)
        came = lambda n: F.when(F.col(DIFF) > 0, F.struct(F.col(n).cast(kinds[n]).alias("v"))).alias(f"_came_{n}")
        given = [c.select(self.key, F.lit(n).alias("_of"), came(n)) for n, c in zip(self.names, changes) if c is not None]
        stacked = given[0]
        for d in given[1:]:
            stacked = stacked.unionByName(d, allowMissingColumns=True)
        changed = [n for n, c in zip(self.names, changes) if c is not None]
        moved = [F.bool_or(F.col("_of") == n).alias(f"_moved_{n}") for n in changed]
        both = self.store.history(cut(stacked)).groupBy(self.key)
        both = both.agg(self.store.last_of().alias(OLD), F.count("_of").alias("_named"), *moved, *(F.first(f"_came_{n}", ignorenulls=True).alias(f"_came_{n}") for n in changed)).filter("_named > 0")
        columns, there = [], []
        for n in self.names:
            default = F.lit(self.defaults.get(n)).cast(kinds[n])
            kept, had = F.when(F.col(f"{OLD}.{self.THERE}{n}"), F.col(f"{OLD}.{n}")), F.coalesce(F.col(f"{OLD}.{self.THERE}{n}"), F.lit(False))
            if n in changed:
                is_moved = F.coalesce(F.col(f"_moved_{n}"), F.lit(False))
                kept, had = F.when(is_moved, F.col(f"_came_{n}.v")).otherwise(kept), F.when(is_moved, F.col(f"_came_{n}").isNotNull()).otherwise(had)
            columns.append(F.coalesce(kept, default).alias(n))
            there.append(had.alias(f"{self.THERE}{n}"))
        rows = both.select(self.key, OLD, *columns, *there)
        some = F.greatest(*(F.col(f"{self.THERE}{n}") for n in self.names)) if len(self.names) > 1 else F.col(f"{self.THERE}{self.names[0]}")
        return rows.select(self.key, OLD, F.when(some, packed(self.store.values)).alias(NEW))

    def _anew(self, changes: list[DataFrame | None]) -> DataFrame:
        """(key, _old, _new) from lookups of the touched keys in each frame."""
        touched = cut(union(*(c.select(self.key) for c in changes if c is not None)).distinct())
        store = self.store
        new = self._row([c.at(touched, [self.key]) for c in self.children])
        old = store.lookup(touched, [self.key])
        stacked = old.select(self.key, packed(store.values).alias(OLD)).unionByName(new.select(self.key, packed(store.values).alias(NEW)), allowMissingColumns=True)
        return stacked.groupBy(self.key).agg(F.first(OLD, ignorenulls=True).alias(OLD), F.first(NEW, ignorenulls=True).alias(NEW))


__all__ = ["Frame", "Join", "Reduce", "Rows", "Sorted", "Source", "Stateful", "Wide", "global_rank", "negate", "nullsafe"]
