"""Wide tables whose columns are aggregates or plain values with defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_columns(key: str, parts: dict[str, DataFrame], defaults: dict[str, object], there: str | None = None) -> DataFrame:
    """Full outer merge of (key, column) tables by key; a key that a column lacks gets that column's default.

    The parts are stacked and grouped, so any number of columns takes one shuffle. Each part has unique keys.
    Columns named ``there`` and a part's name, if asked for, tell whether that part has the key.
    """
    stacked = None
    for name, df in parts.items():
        row = df.select(F.col(key), *(F.col(c).alias(c) if c == name else F.lit(None).cast(parts[c].schema[c].dataType).alias(c) for c in parts), F.array(F.lit(name)).alias("_has"))
        stacked = row if stacked is None else stacked.unionByName(row)
    told = [f"{there}{c}" for c in parts] if there else []
    out = stacked.groupBy(key).agg(*(F.max(c).alias(c) for c in parts), *(F.bool_or(F.array_contains("_has", c)).alias(t) for c, t in zip(parts, told)))
    return out.select(key, *(F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in parts), *told)
