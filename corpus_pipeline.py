"""A training corpus from raw documents: reject toxic texts, keep one of each near-duplicate group, put pseudonyms
for personal data, mix sources to target weights, encode.

Each stage takes the documents its predecessor kept, as a table written and read again, and all but the last return
the columns of documents. Rows travel packed in one column, so no column of theirs can clash with a stage's own; an empty
table passes every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, neardup, pii, toxicity
from tidemark.llm.queries import pii_key
from tidemark.runtime import cut, prepare, table

#: The last stage encodes, and no SQL expresses that; tests hold the stages against brute force.
ORACLE_SQL = None


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """Whole rows as one column ``row``, beside what a stage needs of them; null where a row is only nulls."""
    return docs.select(F.struct("*").alias("row"), *more)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the fit never sees held-out labels. Null and empty texts stay, and
    repeated rows are judged alike."""
    prepare(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(packed(docs, F.col("text")), model, ("row",), out="score")
    return scored.filter(F.col("score") < toxicity.PREDICT_FROM).select("row.*")


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked at five-word shingles and 0.8.

    Texts without words and rows without an id stay; of rows that repeat an id one stays.
    """
    prepare(spark)
    judged = neardup.near_duplicates(docs, words=5, percent=80)
    dropped = cut(judged.filter("not kept").select("doc_id").distinct())
    kept = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    repeated = cut(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if not repeated.limit(1).count():
        return kept
    turn = Window.partitionBy("row.doc_id").orderBy(F.xxhash64("row.text"))
    first = packed(kept.join(repeated, "doc_id", "left_semi")).withColumn("turn", F.row_number().over(turn)).filter("turn = 1").select("row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(first.select(*docs.columns))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by format-preserving pseudonyms under the session's key.

    Null and empty texts and all other columns stay as they are; repeated rows are treated alike.
    """
    return pii.pseudonymise(docs, pii_key(spark)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times.

    Texts without words are taken once; rows of one id, source and size are taken alike; null sources are one source.
    """
    prepare(spark)
    mixed = mixing.mix(docs).select("doc_id", "source", "size", "copies").distinct()
    sized = packed(docs, mixing.word_count(F.col("text")).alias("words"))
    taken = sized.join(mixed.filter("copies > 0"), F.expr("row.doc_id <=> doc_id and row.source <=> source and words = size"))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and a digest of what they decode to. A null text has no ids; repeated
    rows are encoded each."""
    prepare(spark)
    encoded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", keep_one_of_near_duplicates),
    ("pii", pseudonymise),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(prepare(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
