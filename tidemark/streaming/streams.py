"""Streams of changes: micro-batches feed tables, and results follow."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.table import KeyedTable
from tidemark.plans.session import Session
from tidemark.runtime import scratch_dir


def follow(session: Session, table: KeyedTable, changes: DataFrame, after: Callable[[int], None] | None = None) -> None:
    """Run a stream of changes to its present end: each micro-batch is queued and propagated.

    ``changes`` is a streaming DataFrame with the table's columns and ``op`` (put or remove): a stream without ``op``
    can't take anything away, so it is required. A ``_seq`` column orders changes of one key inside a batch.
    """
    if "op" not in changes.columns:
        raise ValueError("a stream of changes needs an op column")

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        table.put_all(df.filter("op = 'put'").drop("op"))
        table.remove_all(df.filter("op = 'remove'"))
        session.propagate()
        df.unpersist()
        if after:
            after(number)

    query = changes.writeStream.foreachBatch(batch).option("checkpointLocation", f"{scratch_dir(session.spark)}/streams/{uuid.uuid4().hex}").trigger(availableNow=True).start()
    query.awaitTermination()


def follow_appends(session: Session, table: KeyedTable, rows: DataFrame) -> None:
    """As ``follow`` for a stream that only ever adds or replaces rows."""
    follow(session, table, rows.withColumn("op", F.lit("put")))


def read_files(spark: SparkSession, path: str, schema, files_per_batch: int = 1, file_format: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(file_format).load(path)


def read_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines of a socket as (src, dst) edges, ``src<TAB>dst``."""
    parts = F.split("value", "\t")
    return spark.readStream.format("socket").option("host", host).option("port", port).load().select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"))
