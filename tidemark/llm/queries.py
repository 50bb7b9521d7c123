"""The registered queries of this subpackage, each a thin layer over an operator, and their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import quality
from tidemark.runtime import prepare, scratch_dir, table

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
#: The session's setting that names the secret key of pseudonyms, and what the registered queries use where it is unset.
PII_KEY, DEMONSTRATION_KEY = "spark.tidemark.pseudonyms.key", "for demonstration only"


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get(PII_KEY, DEMONSTRATION_KEY)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix

    return mix(table(prepare(spark), sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.bpe import digests, encode_decode

    return digests(encode_decode(table(prepare(spark), sf_dir, "documents"), public_tokenizers.path(BYTE_BPE)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import toxicity

    return toxicity(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.counts import token_counts

    return token_counts(table(prepare(spark), sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.codec import read_files, write_files

    folder = f"{scratch_dir(prepare(spark))}/tokens/{uuid.uuid4().hex}"
    manifest = write_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(WORD_BPE), end=2)
    return read_files(manifest, folder, digest=True)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import quality_rules

    judged = quality_rules(table(prepare(spark), sf_dir, "documents"))
    return judged.drop("lang", "source", "n_lines")


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.substring import repeated_passages

    return repeated_passages(table(prepare(spark), sf_dir, "documents"), window=35, with_text=False)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.neardup import near_duplicates

    return near_duplicates(table(prepare(spark), sf_dir, "documents"), words=4, percent=80)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ann import nearest

    vectors = table(prepare(spark), sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pii import pseudonymise

    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, pii_key(spark), count="n_pseudonyms")


QUERIES = {"op1_mixing": op1_mixing, "op2_bpe": op2_bpe, "op3_toxicity": op3_toxicity, "op4_token_counts": op4_token_counts, "op5_token_files": op5_token_files, "op6_quality_rules": op6_quality_rules, "op7_repeated_passages": op7_repeated_passages, "op8_near_duplicates": op8_near_duplicates, "op9_nearest": op9_nearest, "op10_pii": op10_pii}
SQL: dict[str, str] = {"op6_quality_rules": quality.SQL}
