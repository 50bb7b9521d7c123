"""Graph files and seeded generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) from lines ``src<TAB>dst``; lines starting with # are left out."""
    line = spark.read.text(path).filter(~F.col("value").startswith("#"))
    parts = F.split("value", "\t")
    pair = line.select(F.try_element_at(parts, F.lit(1)).try_cast("long").alias("src"), F.try_element_at(parts, F.lit(2)).try_cast("long").alias("dst"))
    return pair.filter("src is not null and dst is not null")


def read_graph_trace(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges before the line ``---``, and after it the changes (seq, op, src, dst) of lines ``add|remove<TAB>src<TAB>dst``.

    The two kinds of lines differ in form, so the marker's place isn't needed to tell them apart.
    """
    lines = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())
    parts = F.split("value", "\t")
    ops = lines.filter(F.col("value").rlike(r"^(add|remove)\t")).select("seq", parts[0].alias("op"), parts[1].cast("long").alias("src"), parts[2].cast("long").alias("dst"))
    return read_edges(spark, path), ops


def random_edges(spark: SparkSession, nodes: int, seed: int, mean_degree: int = 14) -> DataFrame:
    """A seeded random graph: about ``mean_degree`` edges out of each node, targets uniform."""
    out = spark.range(nodes).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(2 * mean_degree + 1)).cast("int"))).alias("i"))
    return out.select("src", F.pmod(F.xxhash64(F.lit(seed + 1), "src", "i"), F.lit(nodes)).alias("dst"))


def random_ints(spark: SparkSession, count: int, seed: int) -> DataFrame:
    """``count`` unique keys below 1000 * count, with seeded values."""
    return spark.range(count).select((F.col("id") * 1000 + F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1000))).alias("key"), F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(count)).alias("value"))


def random_texts(spark: SparkSession, count: int, seed: int) -> DataFrame:
    """Seeded texts of one to ten words."""
    words = F.array(*(F.lit(w) for w in ("ant", "bee", "cow", "doe", "elk", "fox")))
    n = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(10)).cast("int")
    text = F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.element_at(words, (F.pmod(F.xxhash64(F.lit(seed + 1), F.col("id"), i), F.lit(6)) + 1).cast("int"))), " ")
    return spark.range(count).select(F.col("id").cast("string").alias("key"), text.alias("value"))


def _seeded(column: str, seed: int) -> str:
    return f"({column} * 48271 + {seed}) % 2147483647"


def seeded_ints(keys: DataFrame, seed: int, below: int) -> DataFrame:
    """A value below ``below`` for each of the ``keys`` (key)."""
    return keys.select("key", F.expr(f"{_seeded('key', seed)} % {below}").alias("value"))


def seeded_updates(keys: DataFrame, seed: int, below: int) -> DataFrame:
    """A change for two thirds of the keys: (op, key, value), op being update or remove; a removal has a null value."""
    turn = f"{_seeded('key', seed)} % 3"
    op = F.expr(f"case {turn} when 1 then 'update' when 2 then 'remove' end")
    return keys.select(op.alias("op"), "key", F.expr(f"if({turn} = 1, {_seeded('key', seed)} % {below}, null)").alias("value")).filter("op is not null")


def text_updates(texts: DataFrame, seed: int) -> DataFrame:
    """New texts for the updated keys of a table (key, value), removals for others: (op, key, value)."""
    turn = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(3))
    fresh = F.concat_ws(" ", F.col("value"), F.element_at(F.array(*(F.lit(w) for w in ("ant", "bee", "gnu"))), (F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.lit(3)) + 1).cast("int")))
    return texts.select(F.when(turn == 1, "update").when(turn == 2, "remove").alias("op"), "key", F.when(turn == 1, fresh).alias("value")).filter("op is not null")


def edge_updates(edges: DataFrame, nodes: int, seed: int) -> DataFrame:
    """Removals of about a tenth of the edges and as many new ones: (op, src, dst), op being remove or add."""
    turn = F.pmod(F.xxhash64(F.lit(seed), "src", "dst"), F.lit(10))
    moved = F.when(turn == 0, F.array(F.struct(F.lit("remove").alias("op"), "src", "dst"))).when(turn == 1, F.array(F.struct(F.lit("add").alias("op"), F.col("src"), F.pmod(F.xxhash64(F.lit(seed + 1), "src", "dst"), F.lit(nodes)).alias("dst"))))
    return edges.select(F.explode(moved).alias("m")).select("m.*")


def write_graph_trace(edges: DataFrame, updates: DataFrame, path: str) -> None:
    """The file that ``read_graph_trace`` reads: edges, a line ``---``, then the changes."""
    spark = edges.sparkSession
    head = edges.select(F.lit(0).alias("o"), F.concat_ws("\t", "src", "dst").alias("value"))
    mark = spark.createDataFrame([(1, "---")], "o int, value string")
    tail = updates.select(F.lit(2).alias("o"), F.concat_ws("\t", "op", "src", "dst").alias("value"))
    head.unionByName(mark).unionByName(tail).orderBy("o", "value").select("value").write.mode("overwrite").text(path)
