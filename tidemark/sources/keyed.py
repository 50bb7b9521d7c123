"""Keyed text, change logs and update files."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from tidemark.operators.table import KeyedTable
    from tidemark.plans.session import Session

SEPARATOR = "\x1f"


def read_pairs(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """(key, value) from lines ``key 0x1F value``; further fields are ignored, a line without separator has a null value."""
    line = spark.read.text(path)
    parts = F.split("value", SEPARATOR)
    pairs = line.select(parts[0].alias("key"), F.try_element_at(parts, F.lit(2)).alias("value"))
    return pairs.repartition(partitions, "key") if partitions else pairs


def write_pairs(pairs: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write (key, value) as keyed text, hash-split into ``partitions`` files if asked."""
    out = pairs.repartition(partitions, "key") if partitions else pairs
    out.select(F.concat_ws(SEPARATOR, F.col("key").cast("string"), F.col("value").cast("string")).alias("value")).write.mode("overwrite").text(path)


def hash_partition(key: Column, partitions: int) -> Column:
    """Partition number of an integral key, never negative."""
    return F.pmod(key.cast("long"), F.lit(partitions)).cast("int")


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    """(key, value, _seq) from keyed text in the order of its lines; later puts of a key win in ``KeyedTable.put_all``."""
    return read_pairs(spark, path).withColumn("_seq", F.monotonically_increasing_id())


def split_updates(pairs: DataFrame, folder: str, size: int, repeats: int) -> list[str]:
    """Cut an ordered table (key, value, _seq) into ``repeats`` update files of ``size`` rows, named <size>-<n>."""
    from tidemark.plans.frame import global_rank

    ranked = global_rank(pairs, [F.col("_seq")], "_n").withColumn("_file", F.floor((F.col("_n") - 1) / size))
    paths = []
    for i in range(repeats):
        path = f"{folder}/{size}-{i}"
        write_pairs(ranked.filter(F.col("_file") == i), path, 1)
        paths.append(path)
    return paths


def update_paths(spark: SparkSession, folder: str) -> list[str]:
    """The update files <size>-<n> of a folder, in the order of n, then of size."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = [s.getPath() for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    parts = [(m, str(p.toString())) for p in found if (m := re.fullmatch(r"(\d+)-(\d+)", p.getName()))]
    return [p for _, p in sorted(parts, key=lambda x: (int(x[0][2]), int(x[0][1])))]


def replay(session: Session, table: KeyedTable, folder: str) -> int:
    """Apply the update files of a folder one after another; results follow each. Returns how many there were."""
    paths = update_paths(session.spark, folder)
    for p in paths:
        table.put_all(read_updates(session.spark, p))
        session.propagate()
    return len(paths)


def read_oplog(spark: SparkSession, path: str) -> DataFrame:
    """(seq, batch, op, key, value) from lines ``adding|removing|updating|generated (k,v)``; ``---`` ends a batch.

    Lines in the comma form ``op,key[,value]`` are read as well. Lines are numbered from 1, batches from 0. Each part
    of a file counts its own lines and ends of batches, and adds those of the parts before it.
    """
    numbered = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)).withColumn("_end", (F.trim("value") == "---").cast("long"))
    parts = numbered.groupBy("_part").agg(F.count("*").alias("_lines"), F.sum("_end").alias("_ends"))  # one row a part
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_lines"), F.coalesce(F.sum("_ends").over(before), F.lit(0)).alias("_ends"))
    within = Window.partitionBy("_part").orderBy("_id")
    placed = numbered.withColumn("_n", F.row_number().over(within)).withColumn("_passed", F.sum("_end").over(within)).join(offsets, F.col("_part") == F.col("_p"))
    form = r"^\s*(generated|adding|removing|updating)\s*(?:\(([^,]*),(.*)\)|,([^,]*)(?:,(.*))?)\s*$"
    part = lambda i: F.regexp_extract("value", form, i)
    either = lambda a, b: F.trim(F.when(part(2) != "", part(a)).otherwise(part(b)))
    return placed.filter(F.col("value").rlike(form)).select(
        (F.col("_lines") + F.col("_n")).alias("seq"), (F.col("_ends") + F.col("_passed")).cast("int").alias("batch"), part(1).alias("op"), either(2, 4).alias("key"), either(3, 5).alias("value")
    )


def write_sorted_text(pairs: DataFrame, path: str) -> None:
    """``key -> value`` lines in the order of the keys."""
    pairs.orderBy("key").select(F.concat_ws(" -> ", F.col("key").cast("string"), F.col("value").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_number(df: DataFrame, path: str) -> None:
    """A one-row, one-column result as a line of text."""
    df.select(F.col(df.columns[0]).cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)

