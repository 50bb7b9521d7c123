"""What keeps a task's memory, the driver's traffic and shuffles in proportion as tables grow, seen in small plans."""

import pytest

from conftest import SF
from pyspark.sql import functions as F

from tidemark import runtime
from tidemark.operators import store
from tidemark.operators.agg import count_of
from tidemark.plans.frame import Rows
from tidemark.plans.session import Session
from tidemark.queries import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunked_counts_keep_only_dictionary_words(spark):
    plan = plan_of(QUERIES["wch_chunked"](spark, SF))
    assert plan.index("keys=[chunk_id") < plan.index("Join")  # printed top down: the join feeds the counts


@pytest.mark.parametrize("name, shuffles", [("chunk_map", 1), ("wc_chunked", 1), ("wc_map_merge", 2)])
def test_words_are_grouped_where_their_text_lies(spark, monkeypatch, name, shuffles):
    want = sorted(map(tuple, QUERIES[name](spark, SF).collect()), key=repr)
    monkeypatch.setattr(runtime, "PART_BYTES", 1 << 14)
    df = QUERIES[name](spark, SF)
    assert plan_of(df).count("Exchange hashpartitioning") == shuffles and "REPARTITION_BY_NUM" in plan_of(df)
    assert sorted(map(tuple, df.collect()), key=repr) == want


@pytest.mark.parametrize("name", ["pagerank_1", "column_pagerank_3"])
def test_edges_are_placed_by_source_in_bounded_parts(spark, monkeypatch, name):
    edges = __import__("tidemark.queries", fromlist=["_edges"])._edges
    monkeypatch.setattr(runtime, "PART_BYTES", 1 << 10)
    few = edges(spark, SF).rdd.getNumPartitions()
    monkeypatch.setattr(runtime, "PART_BYTES", 1 << 8)
    assert edges(spark, SF).rdd.getNumPartitions() > few
    want = QUERIES[name](spark, SF)
    monkeypatch.setattr(runtime, "PART_BYTES", 1 << 20)
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, QUERIES[name](spark, SF).collect()))


def test_spread_takes_part_in_no_change(spark):
    df = spark.range(10)
    assert runtime.spread(df, "id") is df and Rows(df).spread("id").full() is df


def test_broadcasts_are_bounded(spark):
    before = {n: spark.conf.get(n, None) for n in (runtime._BROADCAST, runtime._BROADCAST_LATER)}
    try:
        spark.conf.set(runtime._BROADCAST, "10m")
        spark.conf.unset(runtime._BROADCAST_LATER)
        runtime.prepare(spark)
        assert [int(spark.conf.get(n)) for n in before] == [runtime.BROADCAST_FILE, runtime.BROADCAST_ROWS]
        spark.conf.set(runtime._BROADCAST, "-1")
        spark.conf.set(runtime._BROADCAST_LATER, "-1")
        runtime.prepare(spark)
        assert [spark.conf.get(n) for n in before] == ["-1", "-1"]
    finally:
        for n, v in before.items():
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def test_a_large_change_is_grouped_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(store.KeyedStore.__init__, "__defaults__", (None, 4 << 10))
    monkeypatch.setattr(runtime, "BROADCAST_FILE", 1 << 10)
    largest = []
    for n in (4000, 32000):
        s = Session(spark)
        path = f"{runtime.scratch_dir(spark)}/input-{s.folder}"
        spark.range(n).selectExpr("id as key", "id % 1000 as g", "xxhash64(id) as value").write.parquet(path)
        whole = spark.read.parquet(path)
        t = s.create_table("t", "key", whole)
        out = s.run(s.frame(t).reduce_by_key("g", count_of("n")))
        t.clear()
        s.propagate()
        assert not t.df().limit(1).count() and not out.df().limit(1).count()
        step = t.store.steps[-1]
        assert step.count() == n
        largest.append(max(r[0] for r in step.groupBy(F.input_file_name()).count().select("count").collect()))
        half = whole.filter("key % 2 = 0").withColumn("value", F.lit(7).cast("long"))
        t.put_all(half)
        s.propagate()
        assert sorted(map(tuple, t.df().collect())) == sorted(map(tuple, half.collect()))
        assert sorted(map(tuple, t.lookup(whole.filter("key < 3000")).collect())) == sorted(map(tuple, half.filter("key < 3000").collect()))
        assert sorted(map(tuple, out.df().collect())) == [(g, n // 1000) for g in range(0, 1000, 2)]
        s.close()
    assert largest[1] < 2 * largest[0]
