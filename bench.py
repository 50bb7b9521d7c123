"""Times of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

For word counts, dictionary word counts, token counts, per-document counts and PageRank: ``<name>_naive`` is a run
from scratch, ``<name>_initial`` also builds the state that later updates need, ``<name>_update_<n>`` brings the
result up to date after n changed rows. ``break_even`` is the number of batches of 100 after which maintaining has
cost less than computing anew. The first round warms up and isn't counted; $BENCH_REPEATS rounds follow.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidemark import queries as q  # noqa: E402
from tidemark.functions.text import jsplit, token_count  # noqa: E402
from tidemark.operators import graph  # noqa: E402
from tidemark.operators.agg import count_of, sum_of  # noqa: E402
from tidemark.plans.session import Session  # noqa: E402
from tidemark.runtime import cut, prepare, table  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
#: No further round begins that would probably end later than this; the line printed tells how many were counted.
SECONDS = float(os.environ.get("BENCH_SECONDS", "1200"))
UPDATES = (10, 100, 1000)
FULL = ("map_token_count", "wc", "wc_dict", "cw_total", "reduce_by_key", "join_residual", "mergesort_rank", "pagerank_5")


def ran(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(f) -> float:
    start = time.perf_counter()
    f()
    return time.perf_counter() - start


def words(f):
    return f.flat_map(F.transform(jsplit(F.col("text")), lambda w: F.struct(w.alias("word"))))


def workloads(spark: SparkSession) -> dict:
    docs = table(spark, SF_DIR, "documents").select("doc_id", "text")
    edges = cut(q._edges(spark, SF_DIR).withColumn("id", F.col("src") * 1000000 + F.col("dst")))
    changed_docs = lambda n: docs.filter(F.col("doc_id") < n).withColumn("text", F.concat(F.lit("zz "), "text"))
    changed_edges = lambda n: edges.orderBy("id").limit(n).withColumn("dst", F.col("dst") + 1)

    def dictionary(s, f):
        items = s.create_table("benchmark", "item_id", table(spark, SF_DIR, "benchmark").select("item_id", "text"))
        return words(f).semi_join(words(s.frame(items)).distinct("word"), "word").reduce_by_key("word", count_of("n"))

    return {
        "map": (docs, "doc_id", changed_docs, lambda s, f: f.map(F.col("doc_id"), token_count(F.col("text")).alias("n"))),
        "wc": (docs, "doc_id", changed_docs, lambda s, f: words(f).reduce_by_key("word", count_of("n"))),
        "wch": (docs, "doc_id", changed_docs, dictionary),
        "cw": (docs, "doc_id", changed_docs, lambda s, f: f.map(F.col("doc_id"), token_count(F.col("text")).alias("c")).reduce(sum_of("n", "c"))),
        "pgrank": (edges, "id", changed_edges, lambda s, f: graph.PageRank(f, 5)),
    }


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    times: dict[str, list[float]] = {}
    began, counted = time.perf_counter(), 0
    for round_ in range(REPEATS + 1):
        if round_ > 1 and (time.perf_counter() - began) * (round_ + 1) / round_ > SECONDS:
            break
        counted = round_
        note = lambda name, s: times.setdefault(name, []).append(s) if round_ else None  # noqa: B023, E731
        for name in FULL:
            note(name, timed(lambda: ran(q.QUERIES[name](spark, SF_DIR))))  # noqa: B023
        for name, (rows, key, change, build) in workloads(spark).items():
            session = Session(spark)
            t = session.create_table("t", key, rows)
            frame = build(session, session.frame(t))
            note(f"{name}_naive", timed(lambda: ran(frame.full())))  # noqa: B023
            note(f"{name}_initial", timed(lambda: session.run(frame)))  # noqa: B023
            for n in UPDATES:
                t.put_all(change(n))
                note(f"{name}_update_{n}", timed(session.propagate))
            session.close()
    mean = {k: round(statistics.mean(v), 3) for k, v in times.items()}
    std = {k: round(statistics.pstdev(v), 3) for k, v in times.items()}
    even = {}
    for name in ("map", "wc", "wch", "cw", "pgrank"):
        gain = mean[f"{name}_naive"] - mean[f"{name}_update_100"]
        even[name] = max(0, -(-(mean[f"{name}_initial"] - mean[f"{name}_naive"]) // gain)) if gain > 0 else None
    print(json.dumps({"metric": "total_seconds", "value": round(sum(mean.values()), 3), "unit": "sec", "queries": mean, "std": std, "break_even": even, "sf": Path(SF_DIR).name, "repeats": counted}))


if __name__ == "__main__":
    main()
