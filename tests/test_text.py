from pyspark.sql import functions as F

from tidemark.functions.text import jsplit, token_count

CASES = {"": [""], " ": [], " foo": ["", "foo"], "foo ": ["foo"], "...": [], "a b  ": ["a", "b"], "é1": ["", "1"], None: None}


def test_split_keeps_leading_and_drops_trailing_empties(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "text string")
    for r in df.select("text", jsplit(F.col("text")).alias("w"), token_count(F.col("text")).alias("n")).collect():
        assert r.w == CASES[r.text]
        assert r.n == (None if r.text is None else len(CASES[r.text]))


def test_jsplit_at_line_ends_and_long_runs(spark):
    cases = {"": [""], "\n": [], "a\n": ["a"], "\r\n.a": ["", "a"], "a" + "." * 5000: ["a"], "." * 5000: [], "a..b\n\n": ["a", "b"], "é": [], "aéb": ["a", "b"], "_": ["_"]}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", jsplit(F.col("t")).alias("w"))
    assert {r.t: r.w for r in df.collect()} == cases
