"""Token counts by an exact length histogram (operator 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import token_lengths
from tidemark.runtime import cut

#: Lengths of one block of the two-level suffix sums.
BLOCK = 1024


def length_histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """Documents of each encoded length; partial counts before the shuffle keep a hot length to one row a task."""
    return lengths.groupBy(F.col(length).cast("long").alias("length")).agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L of a histogram (length, n_docs): what a context limit of L means for the corpus.

    Columns: ``n_docs`` of exactly L; ``docs_at_least`` and ``tokens_at_least`` (suffix sums); ``truncated_tokens``,
    all tokens left when each document is cut at L; ``docs_cut``, documents longer than L; ``quantile``, the
    share of documents of length <= L. Between two listed lengths l < c <= L a limit c keeps
    ``truncated_tokens(L) - (L - c) * docs_at_least(L)``. An empty histogram gives no rows.

    Sums run over blocks of lengths first and inside each block then, so no task sees more than one block of rows.
    """
    h = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.expr(f"length div {BLOCK}").alias("block"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    # One row for each BLOCK lengths, at most longest text / BLOCK rows in all.
    later = Window.partitionBy(F.lit(0)).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("block_docs").over(every).alias("all_docs"),
        F.sum("block_tokens").over(every).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = h.join(blocks, "block").select(
        "length",
        "n_docs",
        (F.sum("n_docs").over(within) + F.col("later_docs")).alias("docs_at_least"),
        (F.sum("tokens").over(within) + F.col("later_tokens")).alias("tokens_at_least"),
        "all_docs",
        "all_tokens",
    )
    cut = F.col("docs_at_least") - F.col("n_docs")
    return s.select(
        "length",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        cut.alias("docs_cut"),
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
        ((F.col("all_docs") - cut) / F.col("all_docs")).alias("quantile"),
    )


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Suffix sums over the exact token lengths of every whole text of ``docs`` (null: length 0)."""
    return suffix_sums(cut(length_histogram(token_lengths(docs, vocabulary, text))))  # written: texts are encoded once
