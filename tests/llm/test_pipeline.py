"""The pipeline's stages on a small fixture, each against its own rule, and the oracles of operators that SQL can express."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline

from advisorium.llm.common import cut

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = cut(stage(spark, before, SF), f"test-{name}")
        assert after.columns == columns
        assert after.join(before, "doc_id", "left_anti").count() == 0
        counts.append(after.count())
        if name == "personal_data":
            assert after.count() == before.count()
            assert after.where(F.col("text").rlike(r"[a-z0-9]@[a-z0-9]+\.[a-z]")).count() == 0
            assert after.where("n_chars <> length(text)").count() == 0
        before = after
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert pieces.select("doc_id").distinct().count() == before.count()


def test_language_stage_keeps_every_text_with_letters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    words = ["a", "la", "de", "in", "an", "es", "on", "en", "é ß", "ñ ö ç", "æøåþð", "zzzz qqqq", "123 !", "", None]
    more = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(words)], docs.schema)
    both = cut(docs.unionByName(more), "test-both")
    got = {r.doc_id for r in corpus_pipeline.language(spark, both, SF).select("doc_id").collect()}
    assert got == {r.doc_id for r in both.collect() if any(map(str.isalpha, r.text or ""))}


def test_copies_under_one_id_or_none_stay_once(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (1, a), (2, b), (2, b + " more"), (3, c), (None, c), (None, d), (None, d), (None, d + " more"), (4, None), (4, None), (None, None)]
    docs = cut(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")), "test-copies")
    after = corpus_pipeline.unique(spark, docs, SF)
    assert after.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in after.collect()]
    named = [x for x in kept if x[0] is not None]
    assert sorted(named, key=str) == sorted([(1, a), (2, b), (2, b + " more"), (3, c), (4, None), (4, None)], key=str)
    nameless = [t for i, t in kept if i is None]
    assert len(nameless) == 2 and None in nameless and (d in nameless) != (d + " more" in nameless)


def test_redaction_keeps_columns_of_any_name(spark):
    rows = [(1, "mail a@b.co now", "x"), (1, "other", "y"), (None, "call +1 555 010 1234 5 now", "z"), (2, None, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, clean string")
    for name in ("spans", "s_id", "s_digest", "doc", "key", "row", "hash"):
        docs = docs.withColumn(name, F.lit("kept"))
    docs = cut(docs.withColumn("n_chars", F.lit(7).cast("long")), "test-clash")
    after = corpus_pipeline.private(spark, docs, SF)
    assert after.columns == docs.columns
    got = {r.clean: r for r in after.collect()}
    assert (got["x"].text, got["y"].text, got["w"].text) == ("mail <email> now", "other", None)
    assert got["z"].text == "call <phone> now" and got["z"].n_chars == len(got["z"].text) and got["y"].n_chars == 7
    assert all(r.spans == r.doc == r.key == "kept" for r in got.values())
    unique = corpus_pipeline.unique(spark, docs, SF)
    assert unique.columns == docs.columns and unique.count() == 4


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize("name", ["op1_url_filter", "op2_topk", "op9_hnsw", "op10_minhash"])
def test_operator_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(found.columns)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(map(str, (tuple(r) for r in found.select(*columns).collect()))) == sorted(map(str, want.select(*[f'"{c}"' for c in columns]).fetchall()))
