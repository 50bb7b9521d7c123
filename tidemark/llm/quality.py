"""Quality rules with adaptive thresholds (operator 6).

Fixed base rules catch what is junk anywhere. What passes them is compared with its own kind: each language and
source gets a fence around the middle of its values, read from quantile sketches, its own ones drawn towards those of its
language the more the fewer documents it has. A sketch is the counts of an
integer value in bins of at most 1/128 relative width, so sketches merge by adding counts, in any order, with the
same result on every run; hot sources shrink to a few thousand bins before anything is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import cut

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
#: Measures that are fenced: integer value of a document, whether low values fail too, least width of the middle.
MEASURES = {
    "symbols": ("1000 * n_symbols div word_chars", False, 25),
    "dup_lines": ("1000 * n_dup_lines div n_lines", False, 130),
    "word_length": ("100 * word_chars div n_words", True, 75),
}
#: A fence lies this many widths (third less first quartile) beyond a quartile.
REACH = 3
#: A language's quartiles count as so many documents of each of its sources, the corpus's as so many of each language:
#: a source of a few documents is judged nearly as its language is, one of many by its own values.
PRIOR_DOCS = 200


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight that occur twice or more in the text, first occurrences included; exact."""
    if len(words) <= WINDOW:
        return 0
    known: dict[bytes, int] = {}
    ranks = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    span = 1
    while span < WINDOW:  # ranks of windows twice as long, from pairs of ranks
        pairs = ranks[:-span] * (int(ranks.max()) + 1) + ranks[span:]
        ranks = np.unique(pairs, return_inverse=True)[1].reshape(-1)
        span *= 2
    starts = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """COUNTS of one whole text."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.encode("utf-8").split()  # bytes split at exactly the six ASCII spaces
    lines = Counter(x for x in text.split("\n") if x.strip(SPACE))
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        lines.total(),
        lines.total() - len(lines),
        repeated_words(words),
    )


def base_metrics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """COUNTS (long) and ``base_failed`` for every row, beside the columns ``keep``. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measure(t) for t in batch.column(0).to_pylist()], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], [*keep, *COUNTS])

    chosen = docs.select(F.col(text).cast("string").alias("__text"), *keep)
    kinds = [f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} long" for c in COUNTS]
    out = chosen.mapInArrow(run, ", ".join(kinds))
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def bin_of(value: Column) -> Column:
    """Lower end of a value's bin: exact below 256, then the leading eight bits."""
    shift = F.length(F.bin(value)) - 8
    return F.when(value < 256, value).otherwise(F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift))


def fences(metrics: DataFrame) -> DataFrame:
    """Lower and upper fence of each measure per (lang, source), from sketches over the rows that pass the base rules."""
    cells = F.array(*(F.struct(F.lit(m).alias("measure"), bin_of(F.expr(f"({e})")).alias("bin")) for m, (e, _, _) in MEASURES.items()))
    sketch = (
        metrics.filter("not base_failed")
        .select("lang", "source", F.explode(cells).alias("c"))
        .groupBy("lang", "source", "c.measure", "c.bin")
        .agg(F.count("*").alias("n"))
    )
    levels = [["lang", "source"], ["lang"], []]
    merged = None
    for depth, keys in enumerate(levels):
        one = sketch if not depth else sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
        one = one.select(F.lit(depth).alias("level"), *(F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in levels[0]), "measure", "bin", "n")
        merged = one if merged is None else merged.unionByName(one)
    group = Window.partitionBy("level", "lang", "source", "measure")
    ranked = merged.withColumn("below", F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(group))
    quartile = lambda k: F.min(F.when(4 * F.col("below") >= k * F.col("total"), F.col("bin")))
    q = cut(ranked.groupBy("level", "lang", "source", "measure").agg(quartile(1).alias("q1"), quartile(3).alias("q3"), F.first("total").alias("total")))
    drawn = lambda c: F.expr(f"(total * {c} + {PRIOR_DOCS} * p_{c}) div (total + {PRIOR_DOCS})").alias(c)
    level = lambda d, *keys: q.filter(F.col("level") == d).select(*keys, "measure", "q1", "q3", "total")
    corpus = level(2).select(F.col("measure").alias("p_measure"), F.col("q1").alias("p_q1"), F.col("q3").alias("p_q3"))  # a row for each measure
    languages = level(1, "lang").join(F.broadcast(corpus), F.expr("measure = p_measure")).select("lang", "measure", drawn("q1"), drawn("q3"))
    languages = languages.select(F.col("lang").alias("p_lang"), F.col("measure").alias("p_measure"), F.col("q1").alias("p_q1"), F.col("q3").alias("p_q3"))
    own = level(0, "lang", "source").join(languages, F.expr("lang <=> p_lang and measure = p_measure")).select("lang", "source", "measure", drawn("q1"), drawn("q3"))
    least = F.create_map(*(F.lit(x) for m, (_, _, w) in MEASURES.items() for x in (m, w)))[F.col("measure")]
    width = REACH * F.greatest(F.col("q3") - F.col("q1"), least)
    own = own.select("lang", "source", "measure", (F.col("q1") - width).alias("low"), (F.col("q3") + width).alias("high"))
    per = [F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m in MEASURES for side in ("low", "high")]
    return own.groupBy("lang", "source").agg(*per)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Base counts, ``base_failed`` and ``kept`` for every row of ``docs`` (doc_id, text, lang, source).

    A row is kept if it passes the base rules and lies inside all fences of its language and source. Null language
    or source are values of their own; a null text fails the base rules; repeated rows are judged alike; an empty table
    gives an empty result. Only these four columns are read, so no other name can clash.
    """
    metrics = cut(base_metrics(docs))
    inside = F.lit(True)
    for m, (e, both, _) in MEASURES.items():
        inside = inside & (F.expr(f"({e})") <= F.col(f"{m}_high"))
        if both:
            inside = inside & (F.expr(f"({e})") >= F.col(f"{m}_low"))
    limits = fences(metrics).withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    judged = metrics.join(limits, F.expr("lang <=> f_lang and source <=> f_source"), "left")
    return judged.select("doc_id", "lang", "source", *COUNTS, "base_failed", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(inside, F.lit(True))).alias("kept"))


_MEASURE_SQL = " union all ".join(f"select lang, source, '{m}' as measure, {e.replace(' div ', ' // ')} as v from ok" for m, (e, _, _) in MEASURES.items())
_WIDTHS = "case measure " + " ".join(f"when '{m}' then {w}" for m, (_, _, w) in MEASURES.items()) + " end"
_JUDGE = " and ".join(
    f"{e.replace(' div ', ' // ')} <= {m}_high" + (f" and {e.replace(' div ', ' // ')} >= {m}_low" if both else "") for m, (e, both, _) in MEASURES.items()
)
_PER = ", ".join(f"max(case when measure = '{m}' then {s} end) as {m}_{s}" for m in MEASURES for s in ("low", "high"))
SQL = rf"""
with d as (
  select doc_id, lang, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), lines as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id
), win as (
  select doc_id, i, w[i:i + 7] as k from (select doc_id, w, unnest(generate_series(1, len(w) - 7)) as i from d where len(w) >= 8)
), rep as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as c from win) where c > 1
), covered as (
  select doc_id, count(distinct i + j) as n_repeat_words from rep, (select unnest(generate_series(0, 7)) as j) group by doc_id
), m as (
  select d.doc_id, lang, source, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_lines, 0)::bigint as n_lines,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from d left join lines using (doc_id) left join covered using (doc_id)
), b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m
), ok as (select * from b where not base_failed
), cells as (
  select lang, source, measure, case when v < 256 then v else (v >> (length(bin(v)) - 8)) << (length(bin(v)) - 8) end as bin
  from ({_MEASURE_SQL})
), sk as (select lang, source, measure, bin, count(*) as n from cells group by all
), lv as (
  select 0 as level, lang, source, measure, bin, n from sk
  union all select 1, lang, null, measure, bin, sum(n) from sk group by lang, measure, bin
  union all select 2, null, null, measure, bin, sum(n) from sk group by measure, bin
), rk as (
  select *, sum(n) over (partition by level, lang, source, measure order by bin) as below,
    sum(n) over (partition by level, lang, source, measure) as total from lv
), q as (
  select level, lang, source, measure, min(case when 4 * below >= total then bin end) as q1,
    min(case when 4 * below >= 3 * total then bin end) as q3, max(total) as total
  from rk group by level, lang, source, measure
), lq as (
  select l.lang, l.measure, (l.total * l.q1 + {PRIOR_DOCS} * c.q1) // (l.total + {PRIOR_DOCS}) as q1, (l.total * l.q3 + {PRIOR_DOCS} * c.q3) // (l.total + {PRIOR_DOCS}) as q3
  from q l join q c on c.level = 2 and l.measure = c.measure where l.level = 1
), sq as (
  select s.lang, s.source, s.measure, (s.total * s.q1 + {PRIOR_DOCS} * p.q1) // (s.total + {PRIOR_DOCS}) as q1, (s.total * s.q3 + {PRIOR_DOCS} * p.q3) // (s.total + {PRIOR_DOCS}) as q3
  from q s join lq p on s.lang is not distinct from p.lang and s.measure = p.measure where s.level = 0
), chosen as (
  select lang, source, measure, q1 - {REACH} * greatest(q3 - q1, {_WIDTHS}) as low, q3 + {REACH} * greatest(q3 - q1, {_WIDTHS}) as high from sq
), per as (select lang, source, {_PER} from chosen group by lang, source
)
select b.doc_id, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.base_failed,
  case when b.base_failed then false else coalesce({_JUDGE}, true) end as kept
from b left join per on b.lang is not distinct from per.lang and b.source is not distinct from per.source
"""
