"""Signed multisets: rows with a ``_diff`` column that counts how often each is added (or, below zero, taken away)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIFF = "_diff"


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != DIFF]


def signed(df: DataFrame, sign: int = 1) -> DataFrame:
    return df.withColumn(DIFF, F.lit(sign).cast("long"))


def negate(delta: DataFrame) -> DataFrame:
    return delta.withColumn(DIFF, -F.col(DIFF))


def consolidate(delta: DataFrame) -> DataFrame:
    """Add up equal rows; what cancels goes, so an unchanged value stops a change here."""
    return delta.groupBy(*data_columns(delta)).agg(F.sum(DIFF).alias(DIFF)).filter(F.col(DIFF) != 0)


def rows(multiset: DataFrame) -> DataFrame:
    """The rows of a consolidated multiset, each as often as it counts."""
    once = multiset.filter(F.col(DIFF) > 0)
    return once.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(DIFF)))).drop(DIFF, "_copy")


def union(*parts: DataFrame | None) -> DataFrame | None:
    """Union of the parts that are there."""
    found = [p for p in parts if p is not None]
    if not found:
        return None
    out = found[0]
    for p in found[1:]:
        out = out.unionByName(p)
    return out


def nullsafe(left: list[str], right: list[str]):
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond


def restrict(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is among ``keys``; null keys match null. Without key columns: all rows."""
    if not on:
        return df
    renamed = keys.select(*(F.col(k).alias(f"_k_{k}") for k in on)).distinct()
    return df.join(renamed, nullsafe(on, [f"_k_{k}" for k in on]), "left_semi")
