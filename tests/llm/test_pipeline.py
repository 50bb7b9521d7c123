from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, mixing, neardup, pii, queries, toxicity
from tidemark.runtime import cut


def test_stages_hand_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = cut(stage(spark, before, SF))
        assert after.columns == columns
        if name == "toxicity":
            scores = toxicity.score(before, toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))).filter(f"score >= {toxicity.PREDICT_FROM}")
            assert after.count() == before.count() - scores.count()
        if name == "near_dedup":
            assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in neardup.near_duplicates(before, 5).filter("kept").collect()}
            assert neardup.near_duplicates(after, 5).filter("not kept").count() == 0
        if name == "pii":
            want = pii.pseudonymise(before, queries.pii_key(spark)).select("doc_id", "text").collect()
            assert sorted(map(tuple, after.select("doc_id", "text").collect())) == sorted(map(tuple, want))
            assert after.count() == before.count() and after.filter("text like '%@mail%'").count() == before.filter("text like '%@mail%'").count()
        if name == "mixing":
            copies = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
            assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == {i: c for i, c in copies.items() if c}
        before = after
        sizes.append(after.count())
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    want = bpe.encode_decode(before, queries.public_tokenizers.path("byte_bpe_50k.json"))
    assert last.count() == sizes[-1] and last.groupBy().sum("n_tokens").first() == want.groupBy().sum("n_tokens").first()


def test_odd_documents_pass_all_stages(spark):
    rows = [(i, t, None, s, 0, "x") for i, (t, s) in enumerate([(None, "a"), ("", None), ("one two", "a"), ("a b c d e f g h", "b"), ("a b c d e f g h", "b")])]
    docs = spark.createDataFrame(rows + [rows[3], (None, "free", None, "b", 0, "x")], "doc_id long, text string, lang string, source string, n_chars long, row string").withColumn("turn", F.lit(1)).withColumn("score", F.lit("s"))
    for d in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            d = cut(stage(spark, d, SF))
            assert name == "bpe" or d.columns == docs.columns
            if name == "near_dedup" and d.count():
                assert sorted(r.doc_id for r in d.filter("doc_id is not null").collect()) == [0, 1, 2, 3]


def test_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.SQL) <= set(queries.QUERIES)
