"""Bounded, reproducible samples of rows, for fitting only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_keys(keys: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` distinct non-null keys, those of the smallest hashes: the same on every run.

    Only the key column is read and each task keeps ``rows`` candidates, so the result has a proven bound.
    """
    hashed = keys.select(key).filter(F.col(key).isNotNull()).withColumn("__h", F.xxhash64(F.lit(seed), F.col(key)))
    return hashed.groupBy("__h", key).agg(F.count("*").alias("__n")).orderBy("__h", key).limit(rows).select(key)


def rows_of(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` whose key is in the bounded sample ``keys``."""
    return table.join(F.broadcast(keys), key, "left_semi")
