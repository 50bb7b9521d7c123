"""Keyed tables: the mutable inputs. Puts are upserts, removals go by key, and a batch of both becomes a signed change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.delta import DIFF
from tidemark.operators.store import NEW, OLD, KeyedStore, change_of
from tidemark.runtime import cut, spread


class KeyedTable:
    """A versioned collection of rows with unique keys.

    ``put_all`` and ``remove_all`` queue changes; ``advance`` turns the queue into one change (rows with ``_diff``),
    written once, and moves the table from its old to its new version. Of several puts of a key the last wins; a put
    after a removal puts. ``defaults`` fill the columns that a put or ``put_in`` of a new key leaves out. A key that
    repeats in ``initial`` raises ValueError; ``trusted`` leaves that check out.
    """

    def __init__(self, spark: SparkSession, name: str, key: list[str] | str, initial: DataFrame, defaults: dict[str, object] | None = None, trusted: bool = False):
        self.spark, self.name = spark, name
        self.key = [key] if isinstance(key, str) else list(key)
        self.defaults = defaults or {}
        self.schema = initial.schema
        self.values = [c for c in initial.columns if c not in self.key]
        self.store = KeyedStore(initial.select(*self.key, *self.values), self.key)
        if not trusted and spread(self.store.base.select(*self.key), *self.key).groupBy(*self.key).count().filter("count > 1").limit(1).count():
            raise ValueError(f"{name}: a key occurs more than once in the initial rows")
        self.version = 0
        self._queue: list[DataFrame] = []

    # -- changes ------------------------------------------------------------------------------------------------

    def _enqueue(self, df: DataFrame, op: str) -> None:
        absent = [c for c in self.values if c not in df.columns]
        filled = df.withColumns({c: F.lit(None).cast(self.schema[c].dataType) for c in absent}) if absent else df
        given = F.array(*(F.lit(c) for c in self.values if c in df.columns)) if op == "put" else F.array().cast("array<string>")
        # Rows of one batch that share a key: the last in order of a _seq column, if there is one.
        order = F.col("_seq").cast("long") if "_seq" in df.columns else F.monotonically_increasing_id()
        self._queue.append(
            filled.select(*self.key, *(F.col(c).cast(self.schema[c].dataType).alias(c) for c in self.values), F.lit(op).alias("_op"), given.alias("_given"), F.lit(len(self._queue)).alias("_batch"), order.alias("_order"))
        )

    def put_all(self, df: DataFrame) -> None:
        """Upsert rows; columns that ``df`` leaves out keep their value, or get their default under a new key."""
        self._enqueue(df, "put")

    def put_in(self, column: str, df: DataFrame) -> None:
        """Overwrite one column by key."""
        self._enqueue(df.select(*self.key, column), "put")

    def put(self, key: object, **values: object) -> None:
        keys = key if isinstance(key, tuple) else (key,)
        fields = [*zip(self.key, keys), *values.items()]
        schema = ", ".join(f"`{c}` {self.schema[c].dataType.simpleString()}" for c, _ in fields)
        self.put_all(self.spark.createDataFrame([tuple(v for _, v in fields)], schema))

    def remove_all(self, keys: DataFrame, strict: bool = False) -> None:
        """Delete by key, whatever the values. ``strict`` raises KeyError if a key is in no row of the current version."""
        if strict:
            asked = cut(keys.select(*self.key))
            missing = asked.join(self.lookup(asked).select(*self.key), self.key, "left_anti")
            if missing.limit(1).count():
                raise KeyError(f"{self.name}: a key to remove isn't there")
        self._enqueue(keys.select(*self.key), "remove")

    def remove(self, key: object) -> None:
        keys = key if isinstance(key, tuple) else (key,)
        schema = ", ".join(f"`{c}` {self.schema[c].dataType.simpleString()}" for c in self.key)
        self.remove_all(self.spark.createDataFrame([keys], schema), strict=True)

    def clear(self) -> None:
        self.remove_all(self.df().select(*self.key))

    # -- versions -----------------------------------------------------------------------------------------------

    def df(self, version: str = "new") -> DataFrame:
        """The rows of the current version, or of the one before the last ``advance``."""
        return self.store.rows(version)

    def lookup(self, keys: DataFrame, version: str = "new") -> DataFrame:
        """Rows of some keys: only the folders that these keys hash to are read."""
        return self.store.lookup(keys, self.key, version)

    def _merged_queue(self, queue: DataFrame) -> DataFrame:
        """One row a queued key: what is kept under it, whether it was last put or removed, whether a removal came first,
        and the fields given since. ``queue`` is stacked with what is kept, whose rows have none of its columns."""
        at = F.struct("_batch", "_order")
        last = [F.max_by("_op", at).alias("_last"), self.store.last_of().alias(OLD)]
        gone = F.max(F.when(F.col("_op") == "remove", at))
        if len(self._queue) == 1:  # puts of one batch alone, or removals alone
            fields = [F.max_by(F.struct(F.col(c).alias("v")), F.when(F.array_contains("_given", c), at)).alias(f"_put_{c}") for c in self.values]
            return queue.groupBy(*self.key).agg(*last, F.lit(False).alias("_cleared"), *fields).filter("_last is not null")
        live = queue.withColumn("_gone", gone.over(Window.partitionBy(*self.key))).withColumn("_live", F.col("_gone").isNull() | (at > F.col("_gone")))
        fields = [F.max_by(F.struct(F.col(c).alias("v")), F.when(F.col("_live") & F.array_contains("_given", c), at)).alias(f"_put_{c}") for c in self.values]
        return live.groupBy(*self.key).agg(*last, F.bool_or(F.col("_gone").isNotNull()).alias("_cleared"), *fields).filter("_last is not null")

    def advance(self) -> DataFrame | None:
        """Turn queued puts and removals into one written change; None if nothing changes.

        The queue and what is kept under its keys are grouped by key once, each key's old and new row are written side
        by side, and the signed change is read from that.
        """
        self.store.before = (self.store.base, list(self.store.steps))
        if not self._queue:
            return None
        queue = self._queue[0]
        for q in self._queue[1:]:
            queue = queue.unionByName(q)
        queue = cut(queue)
        both, self._queue = self._merged_queue(self.store.history(queue)), []
        keep = F.col(OLD).isNotNull() & ~F.col("_cleared")
        field = lambda c: F.when(F.col(f"_put_{c}").isNotNull(), F.col(f"_put_{c}.v")).when(keep, F.col(f"{OLD}.{c}")).otherwise(F.lit(self.defaults.get(c)).cast(self.schema[c].dataType))
        new = F.when(F.col("_last") == "put", F.struct(F.lit(True).alias("_here"), *(field(c).alias(c) for c in self.values)))
        step = self.store.apply(cut(both.select(*self.key, OLD, new.alias(NEW)).filter(~F.col(OLD).eqNullSafe(F.col(NEW)))))
        if step is None:
            return None
        self.version += 1
        return change_of(step, self.key, self.values)

    @property
    def pending(self) -> bool:
        return bool(self._queue)

    def columns(self) -> list[str]:
        return [*self.key, *self.values]


__all__ = ["DIFF", "KeyedTable"]
