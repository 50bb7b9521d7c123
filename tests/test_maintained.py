"""Results after each batch of changes equal a run from scratch over the rows that are there."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import jsplit
from tidemark.operators import graph
from tidemark.operators.agg import avg_of, count_of, group_of, max_of, opaque, sum_of
from tidemark.operators import store
from tidemark.plans import experiment
from tidemark.plans.frame import Reduce, Wide
from tidemark.plans.session import Session

SCHEMA = "key long, value long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def pairs(spark, items):
    return spark.createDataFrame(list(items), SCHEMA)


def test_map_under_upserts_and_repeated_puts(spark):
    s = Session(spark)
    t = s.create_table("t", "key", spark.createDataFrame([("one", 1), ("two", 2)], "key string, value int"))
    out = s.run(s.frame(t).map("key", "value * 2 as value"))
    assert rows(out.df()) == [("one", 2), ("two", 4)]
    for puts, want in [
        ([("one", 4)], {"one": 8, "two": 4}),
        ([("three", 6)], {"one": 8, "two": 4, "three": 12}),
        ([("one", 7), ("one", 9)], {"one": 18, "two": 4, "three": 12}),
    ]:
        for k, v in puts:
            t.put(k, value=v)
        s.propagate()
        assert rows(out.df()) == sorted(want.items())


def test_running_sums(spark):
    s = Session(spark)
    t = s.create_table("t", "key", pairs(spark, [(1, 1), (2, 2)]))
    out = s.run(s.frame(t).reduce(sum_of("n", "value")))
    assert rows(out.df()) == [(3,)]
    for k, v, want in [(3, 3, 6), (4, 3, 9), (1, 3, 11), (5, 9, 20), (2, 6, 24)]:
        t.put(k, value=v)
        s.propagate()
        assert rows(out.df()) == [(want,)]


def test_word_count_with_retraction(spark):
    s = Session(spark)
    t = s.create_table("d", "key", spark.createDataFrame([(1, "apple boy apple cat"), (2, "boy dog"), (3, "ear")], "key int, text string"))
    words = s.frame(t).flat_map(F.transform(jsplit(F.col("text")), lambda w: F.struct(w.alias("word"))))
    out = s.run(words.reduce_by_key("word", count_of("n")))
    t.put(1, text="face boy")
    t.put(4, text="girl girl")
    s.propagate()
    assert dict(rows(out.df())) == {"face": 1, "boy": 2, "dog": 1, "ear": 1, "girl": 2}
    t.remove(2)
    s.propagate()
    assert dict(rows(out.df())) == {"face": 1, "boy": 1, "ear": 1, "girl": 2}


def build(s, f, right):
    return {
        "filter": f.filter("value % 2 = 0"),
        "sums": f.map_values(g="key % 3").reduce_by_key("g", sum_of("s", "value"), count_of("n"), avg_of("m", "value")),
        "tops": f.map_values(g="key % 3").reduce_by_key("g", max_of("top", "value"), opaque("x", "bit_xor(value)")),
        "top": f.reduce(max_of("top", "value"), key="key"),
        "join": f.join(right, "key", "value > other"),
        "chunks": f.chunk_map("key div 4", count_of("n"), max_of("top", "value")),
        "distinct": f.distinct("value"),
        "group": f.map_values(g="key % 3").reduce_by_key("g", group_of("x", "value", "bit_xor({})", zero="0L"), drop_initial="x"),
        "lookup": right.get(f.filter("value > 9"), "key"),
        "both": f.merge(f.filter("value > 5")),
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_random_changes_drain_and_refill(spark, seed):
    rng = random.Random(seed)
    s = Session(spark)
    now = {k: rng.randrange(20) for k in range(12)}
    other = {k: rng.randrange(20) for k in range(0, 12, 2)}
    t = s.create_table("t", "key", pairs(spark, now.items()))
    u = s.create_table("u", "key", spark.createDataFrame(list(other.items()), "key long, other long"))
    frames = build(s, s.frame(t), s.frame(u))
    results = {n: s.run(f) for n, f in frames.items()}
    for step in range(4):
        if step == 2:
            t.clear()
            now = {}
        else:
            for _ in range(5):
                k = rng.randrange(16)
                if rng.random() < 0.3 and k in now:
                    t.remove_all(pairs(spark, [(k, 0)]))
                    del now[k]
                else:
                    now[k] = rng.randrange(20)
                    t.put(k, value=now[k])
            u.put(step, other=step)
        s.propagate()
        assert rows(t.df()) == sorted(now.items(), key=repr)
        for n, r in results.items():
            assert rows(r.df()) == rows(frames[n].full()), (n, step)


def test_no_change_no_work(spark):
    s = Session(spark)
    t = s.create_table("t", "key", pairs(spark, [(1, 1)]))
    f = s.frame(t).map("key", "value * 2 as value")
    out = s.run(f)
    assert s.propagate() == 0 and out.steps_with_work == 0
    t.put(1, value=1)  # the same value again cancels
    assert s.propagate() == 0 and out.steps_with_work == 0
    assert s.run(f) is out


def test_remove_of_a_missing_key_raises(spark):
    s = Session(spark)
    t = s.create_table("t", "key", pairs(spark, [(1, 1)]))
    with pytest.raises(KeyError):
        t.remove(9)


def test_columns_keep_values_or_take_defaults(spark):
    s = Session(spark)
    t = s.create_table("t", "key", spark.createDataFrame([], "key int, one int, two int, three int"), {"one": 0, "two": 5, "three": -1})
    out = s.run(s.frame(t).project("key", "one", "two", "three"))
    t.put_in("one", spark.createDataFrame([(1, 7)], "key int, one int"))
    s.propagate()
    assert rows(out.df()) == [(1, 7, 5, -1)]
    t.put_in("three", spark.createDataFrame([(1, 3)], "key int, three int"))
    s.propagate()
    assert rows(out.df()) == [(1, 7, 5, 3)]
    t.remove(1)
    t.put_in("two", spark.createDataFrame([(1, 2)], "key int, two int"))
    s.propagate()
    assert rows(out.df()) == [(1, 0, 2, -1)]


def test_maintained_pagerank(spark):
    rng = random.Random(3)
    s = Session(spark)
    edges = {(a, b) for a in range(40) for b in rng.sample(range(40), 3)}
    as_df = lambda es: spark.createDataFrame([(a * 1000 + b, a, b) for a, b in es], "id long, src long, dst long")
    t = s.create_table("e", "id", as_df(edges))
    frame = graph.PageRank(s.frame(t), 3)
    out = s.run(frame)
    for change in range(2):
        gone = set(rng.sample(sorted(edges), 2))
        new = {(rng.randrange(45), rng.randrange(45)) for _ in range(2)}
        t.remove_all(as_df(gone))
        t.put_all(as_df(new))
        edges = (edges - gone) | new
        s.propagate()
        want = dict(rows(graph.pagerank(as_df(edges).select("src", "dst"), 3)))
        got = dict(rows(out.df()))
        assert got.keys() == want.keys()
        assert all(abs(got[n] - want[n]) < 1e-9 for n in want)
    assert "pagerank" in s.dot()


def test_a_repeated_key_is_refused(spark):
    s = Session(spark)
    with pytest.raises(ValueError):
        s.create_table("t", "key", pairs(spark, [(1, 1), (1, 2)]))


def test_large_state_is_read_by_folder(spark, monkeypatch):
    """With many folders, a lookup of a few keys filters on folders, and results stay right while steps merge and fold."""
    monkeypatch.setattr(store.KeyedStore.__init__, "__defaults__", (None, 64))
    monkeypatch.setattr(store, "MERGE_AFTER", 2)
    s = Session(spark)
    now = {k: k % 50 for k in range(400)}
    t = s.create_table("t", "key", pairs(spark, now.items()))
    assert t.store.buckets > 8
    frame = s.frame(t).map_values(g="key % 100").reduce_by_key("g", sum_of("n", "value"))
    out = s.run(frame)
    assert frame.store.buckets > 1
    for step in range(7):
        keys = [(step * 7) % 400, 400 + step]
        t.put_all(pairs(spark, [(k, 1000 + step) for k in keys]))
        t.remove_all(pairs(spark, [(step * 11 + 1, 0)]))
        now |= {k: 1000 + step for k in keys}
        now.pop(step * 11 + 1, None)
        s.propagate()
        want = {}
        for k, v in now.items():
            want[k % 100] = want.get(k % 100, 0) + v
        assert dict(rows(out.df())) == want and rows(t.df()) == sorted(now.items(), key=repr)
        found = t.lookup(pairs(spark, [(7, 0), (399, 0)]))
        assert rows(found) == sorted(((k, now[k]) for k in (7, 399) if k in now), key=repr)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert t.store.buckets == 1 or "PartitionFilters: [_bucket" in plan


def test_the_same_graph_gives_the_same_result(spark):
    s = Session(spark)
    f = s.frame(s.create_table("t", "key", pairs(spark, [(1, 1)])))
    make = lambda: f.filter("value > 0").reduce_by_key("value", count_of("n"))
    assert s.run(make()) is s.run(make())
    assert s.run(f.filter("value > 1").reduce_by_key("value", count_of("n"))) is not s.run(make())
    column = F.col("value") > 0
    assert s.run(f.filter(column)) is s.run(f.filter(column)) and s.run(f.filter(F.col("value") > 0)) is not s.run(f.filter(column))


def test_closing_deletes_what_was_written(spark):
    s = Session(spark)
    t = s.create_table("t", "key", pairs(spark, [(1, 1)]))
    files = t.df().inputFiles()
    assert s.folder in files[0]
    s.close()
    assert not __import__("os").path.exists(files[0].removeprefix("file://"))


def test_pagerank_of_repeated_edges_births_and_deaths(spark):
    s = Session(spark)
    edges = {1: (0, 1), 2: (0, 1), 3: (1, 2), 4: (2, 0), 5: (7, 0)}
    as_df = lambda es: spark.createDataFrame([(i, *e) for i, e in es.items()], "id long, src long, dst long")
    t = s.create_table("e", "id", as_df(edges))
    out = s.run(graph.PageRank(s.frame(t), 4))
    for gone, new in (([2, 5], {}), ([], {6: (9, 9), 7: (2, 0)}), ([1, 3, 4, 6, 7], {8: (5, 6)}), ([8], {}), ([], edges)):
        if gone:
            t.remove_all(as_df({i: (0, 0) for i in gone}))
        if new:
            t.put_all(as_df(new))
        edges = {i: e for i, e in (edges | new).items() if i not in gone}
        s.propagate()
        want = dict(rows(graph.pagerank(as_df(edges).select("src", "dst"), 4)))
        got = dict(rows(out.df()))
        assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in want)


def test_experiment_table(spark):
    base = pairs(spark, [(i, i % 3) for i in range(20)])
    build = lambda f, chunk: f.chunk_map(f"key div {chunk}", count_of("n"))
    found = list(experiment.sweep(spark, base, "key", lambda n: base.limit(n), build, {"partitions": [1, 2], "chunk": [4], "update": [2]}, repeats=1))
    lines = experiment.as_table(found).splitlines()
    assert [r["partitions"] for r in found] == [1, 2] and len(lines) == 3 and lines[0].startswith("partitions\tchunk\tupdate\tnaive_mean")


def test_rows_that_carry_their_key_are_replaced_not_added_up(spark):
    s = Session(spark)
    t = s.create_table("docs", "id", spark.createDataFrame([(i, f"a b a w{i}") for i in range(40)] + [(None, "n n")], "id long, text string"))
    words = s.frame(t).filter("id is null or id <> 5").spread("id").flat_map("transform(split(text, ' '), w -> struct(w as word))", "id")
    result = s.run(words)
    for step in range(11):  # more than are kept apart
        t.put_all(spark.range(step, step + 4).selectExpr("id", f"if(id = 7, '', 'x x y{step}') as text"))
        t.remove_all(spark.createDataFrame([(20 + step,)], "id long"))
        if step == 10:
            t.put_all(spark.createDataFrame([(None, "m m")], "id long, text string"))
        s.propagate()
        got = sorted(map(tuple, result.df().collect()), key=repr)
        assert got == sorted(map(tuple, words.full().collect()), key=repr)
    assert "hashpartitioning(word" not in result.df()._jdf.queryExecution().executedPlan().toString()
    assert result.source is s.sources["docs"] and len(result.replaced) < 9


@pytest.mark.parametrize("many", [False, True])
def test_wide_rows_follow_from_changes_alone(spark, monkeypatch, many):
    if many:  # every change takes the way of large ones, through the hash join or all at once
        monkeypatch.setattr(store.runtime, "BROADCAST_FILE", -1)
        monkeypatch.setattr(store.KeyedStore.__init__, "__defaults__", (None, 512))
    rng = random.Random(11)
    s = Session(spark)
    a = s.create_table("a", "key", pairs(spark, [(k, k % 3) for k in range(20)]))
    b = s.create_table("b", "key", pairs(spark, [(k, k % 5) for k in range(10, 25)]))
    left = s.frame(a).map_values(g="key % 8").aggregate_into("g", sum_of("total", "value"), drop_initial="total")
    right = s.frame(b).map_values(g="key % 11").aggregate_into("g", max_of("top", "value"))
    wide = Wide("g", {"total": left, "top": right}, {"total": -1, "top": -2})
    out = s.run(wide)

    def refuse(*_):
        raise AssertionError("a frame was looked up")

    monkeypatch.setattr(Reduce if many else left, "at", refuse)
    kept = {"a": {k: k % 3 for k in range(20)}, "b": {k: k % 5 for k in range(10, 25)}}
    for _ in range(3):
        for name, t in (("a", a), ("b", b)):
            puts = {rng.randrange(30): rng.randrange(6) for _ in range(6)}
            gone = sorted(rng.sample(sorted(kept[name]), 5))
            t.put_all(pairs(spark, puts.items()))
            t.remove_all(spark.createDataFrame([(k,) for k in gone], "key long"))
            kept[name] = {k: v for k, v in (kept[name] | puts).items() if k not in gone}
        s.propagate()
        totals, tops = {}, {}
        for k, v in kept["a"].items():
            totals[k % 8] = totals.get(k % 8, 0) + v
        for k, v in kept["b"].items():
            tops[k % 11] = max(tops.get(k % 11, v), v)
        totals = {g: v for g, v in totals.items() if v}
        assert rows(out.df()) == sorted([(g, totals.get(g, -1), tops.get(g, -2)) for g in {*totals, *tops}], key=repr)
