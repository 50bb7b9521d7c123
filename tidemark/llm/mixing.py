"""Mixing sources to target weights by entropy balancing (operator 1).

Each document gets a rate, as near to 1 in relative entropy as the targets allow: the rates of a source solve a
convex dual in one multiplier, ``rate = min(MAX_COPIES, exp(multiplier * size / mean size))``, which Newton steps
on distributed sums find. Documents of one source and size share a rate, so the steps run over counts of sizes.
Rates then become whole copies by a hash of the document, and a bounded set of documents of each source settles
what rounding left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Newton steps allowed; with brackets that halve, far fewer are needed.
STEPS = 120
GAP = 1e-6
#: Documents of each source and size class (powers of two) that may settle its rounding error.
SETTLERS = 48


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Target words of each source: (source, source_size, target).

    Sources by code point, null last, take WEIGHTS in turn and share the total of all sizes by weight; no target
    exceeds MAX_COPIES times its source, and what that cuts off is shared again by weight until none is above.
    ``sizes`` has one row per source; each round is one sum over it.
    """
    turn = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())  # one row a source
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(turn) - 1) % len(WEIGHTS) + 1)
    t = cut(sizes.select("source", "source_size", "n_docs", weight.cast("double").alias("weight"), (MAX_COPIES * F.col("source_size")).alias("cap")))
    total, level = float(t.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]), None
    while True:
        full = F.lit(False) if level is None else F.col("cap") <= F.col("weight") * level
        used, open_weight = t.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        new = (total - float(used)) / open_weight if open_weight else level or 0.0
        if level is not None and new <= level:
            break
        level = new
    return t.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level))).drop("cap", "weight")


def solve(histogram: DataFrame, goals: DataFrame) -> DataFrame:
    """Multiplier of each source: (source, source_size, target, mean, multiplier).

    Newton steps on each source's dual, kept inside a bracket. The state has one row per source; gradients and
    curvatures are sums over the counts of sizes; the driver only learns whether a source is still open. A source that
    stays open for STEPS steps raises.
    """
    top = float(MAX_COPIES)
    state = goals.select(
        "source", "source_size", "target", (F.col("source_size") / F.greatest(F.col("n_docs"), F.lit(1))).alias("mean"),
        F.lit(0.0).alias("multiplier"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"),
    )
    capped = F.col("target") >= top * F.col("source_size") * (1 - 1e-12)
    for _ in range(STEPS):
        x = F.col("size") / F.greatest(F.col("mean"), F.lit(1e-9))
        rate = F.least(F.lit(top), F.exp(F.least(F.col("multiplier") * x, F.lit(50.0))))
        words = F.col("n").cast("double") * F.col("size")
        sums = (
            histogram.withColumnRenamed("source", "h_source")
            .join(state, F.expr("h_source <=> source"))
            .groupBy("source", "source_size", "target", "mean", "multiplier", "low", "high")
            .agg(F.sum(words * rate).alias("got"), F.sum(F.when(rate < top, words * rate * x).otherwise(0.0)).alias("slope"))
        )
        off = F.col("got") - F.col("target")
        done = capped | (F.abs(off) <= GAP * F.greatest(F.col("target"), F.lit(1.0)))
        low = F.when(off < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(off >= 0, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.when(F.col("slope") > 0, F.col("multiplier") - off / F.when(F.col("slope") > 0, F.col("slope")))
        # A step that would leave the bracket halves it instead; an end not yet found is moved out by doubling.
        inside = F.when((newton > low) & (newton < high) & (F.abs(newton - F.col("multiplier")) <= 2), newton)
        halved = F.when(low <= -1e6, F.col("multiplier") - F.greatest(F.lit(1.0), F.abs(F.col("multiplier")))).when(high >= 1e6, F.col("multiplier") + F.greatest(F.lit(1.0), F.abs(F.col("multiplier")))).otherwise((low + high) / 2)
        state = cut(sums.select(
            "source", "source_size", "target", "mean", F.when(done, F.col("multiplier")).otherwise(F.coalesce(inside, halved)).alias("multiplier"),
            low.alias("low"), high.alias("high"), done.alias("done"),
        ))
        if not state.filter("not done").limit(1).count():
            break
        state = state.drop("done")
    else:
        raise RuntimeError(f"sources without a solution after {STEPS} Newton steps")
    return state.select("source", "source_size", "target", "mean", "multiplier", (F.col("target") >= top * F.col("source_size") * (1 - 1e-12)).alias("capped"))


def _draw(*keys: str) -> Column:
    """A number in [0, 1) that depends on the document alone."""
    return F.pmod(F.xxhash64(F.lit(11), *keys), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source's settlers: change copies by one where that brings the words taken nearer to the target."""
    over = float(pdf["over"].iloc[0])
    pdf = pdf.sort_values(["size", "u", "doc_id"], ascending=[False, True, True])
    change = []
    for size, m, copies in zip(pdf["size"], pdf["m"], pdf["copies"]):
        step, words = 0, float(size) * float(m)
        if over > 0 and copies > 0 and abs(over - words) < abs(over):
            step = -1
        elif over < 0 and copies < MAX_COPIES and abs(over + words) < abs(over):
            step = 1
        over += step * words
        change.append(step)
    out = pdf.assign(change=change)
    return out.loc[out["change"] != 0, ["doc_id", "source", "size", "change"]]


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Copies of each document so that the words of each source come near its target.

    Returns (doc_id, source, size, source_size, target, rate, copies, taken) with taken = copies * size and at most
    three copies. Null text has size 0 and one copy; a null source is a source of its own, last in order; rows that
    repeat an id get the same copies if their sizes agree; a null id is a value like others; an empty table gives
    an empty result; only the three columns are read, so no other name can clash. The same table gives the same copies on every run.
    """
    kind = docs.schema[key].dataType.simpleString()
    sizes = cut(docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")))
    histogram = cut(sizes.groupBy("source", "size").agg(F.count("*").alias("n")))
    goals = targets(histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs")))
    solved = solve(histogram, goals)

    x = F.col("size") / F.greatest(F.col("mean"), F.lit(1e-9))
    rates = (
        histogram.withColumnRenamed("source", "h_source")
        .join(solved, F.expr("h_source <=> source"))
        .select("h_source", F.col("size").alias("h_size"), "source_size", "target",
                F.when(F.col("size") == 0, 1.0).when(F.col("capped"), float(MAX_COPIES)).otherwise(F.least(F.lit(float(MAX_COPIES)), F.exp(F.least(F.col("multiplier") * x, F.lit(50.0))))).alias("rate"))
    )
    rated = sizes.join(rates, F.expr("source <=> h_source and size = h_size")).withColumn("u", _draw("doc_id", "size"))
    rounded = cut(rated.select("doc_id", "source", "size", "source_size", "target", "rate", "u", F.least(F.lit(MAX_COPIES), F.floor(F.col("rate") + F.col("u"))).cast("int").alias("copies")))

    over = rounded.groupBy("source").agg((F.sum(F.col("copies") * F.col("size")) - F.first("target")).alias("over"))
    whole = rounded.filter("size > 0").groupBy("doc_id", "source", "size", "copies", "u").agg(F.count("*").alias("m"))
    nearest = Window.partitionBy("source", "class").orderBy("u", "doc_id", "size")
    settlers = (
        whole.withColumn("class", F.floor(F.log2("size")).cast("int"))
        .withColumn("place", F.row_number().over(nearest))
        .filter(F.col("place") <= SETTLERS)
        .join(over.withColumnRenamed("source", "o_source"), F.expr("source <=> o_source"))
    )
    # At most SETTLERS rows for each power of two come together for a source.
    changes = settlers.select("doc_id", "source", "size", "u", "m", "copies", "over").groupBy("source").applyInPandas(_settle, f"doc_id {kind}, source string, size long, change int")
    changes = changes.withColumnsRenamed({"doc_id": "c_id", "source": "c_source", "size": "c_size"})
    final = rounded.join(changes, F.expr("doc_id <=> c_id and source <=> c_source and size = c_size"), "left")
    copies = F.col("copies") + F.coalesce("change", F.lit(0))
    return final.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
