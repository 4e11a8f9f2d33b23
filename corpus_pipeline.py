"""The corpus pipeline: language ID, quality, near-duplicates, personal data, packing.

Every stage takes what its predecessor kept, with the columns of documents, and works on all of it. Rows of
a repeated id share one decision: they go only if all of them are rejected. Rows with a null id are never
rejected by language or quality; a null text has no letters and so goes, with its id, in the first stage. An empty
table passes through all stages. Further columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advisorium.llm import langid, minhash, packing, pii, quality
from advisorium.llm.common import cut, without


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose language can't be told because they hold no letters; short or mixed ones are as good as any."""
    found = cut(langid.languages_of(docs, public_tokenizers.path("piece_bpe_32k.model")), "language")
    told = F.col("lang_pred") != "und"
    return without(docs, found.groupBy(F.col("doc_id").alias("id")).agg(F.max(told).alias("keep")).where("not keep"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the quality classifier, learnt from the labels of those at hand, predicts to be bad."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    found = cut(quality.quality_scores(docs, labels), "quality")
    return without(docs, found.groupBy(F.col("doc_id").alias("id")).agg(F.max("predicted").alias("keep")).where("keep = 0"))


def once(docs: DataFrame, key: list[str]) -> DataFrame:
    """docs with one row of each group of equal keys and texts; rows with a null text stay.

    Only hashes of the texts are grouped; rows move only where there are copies.
    """
    # documents stay in one struct, whatever their columns are called
    hashed = docs.select(F.struct("*").alias("doc"), F.struct(*key).alias("key"), F.sha2("text", 256).alias("hash"))
    copied = cut(hashed.where("hash is not null").groupBy("key", "hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("c_key"), F.col("hash").alias("c_hash")), "copied")
    if copied.isEmpty():
        return docs
    same = (F.col("hash") == F.col("c_hash")) & F.col("key").eqNullSafe(F.col("c_key"))
    single = hashed.join(copied, same, "left_anti")
    return single.unionByName(hashed.join(copied, same, "left_semi").dropDuplicates(["key", "hash"])).select("doc.*")


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id; those without an id come after all others.

    Rows of one id, or of none, with equal texts are one document.
    """
    docs = once(docs, ["doc_id"]).select(F.struct("*").alias("doc"), F.col("doc_id").alias("own_id"), F.col("text").alias("own_text"))
    nameless = docs.where("own_id is null")
    if not nameless.isEmpty():
        top = docs.agg(F.max("own_id")).first()[0]
        numbered = nameless.withColumn("own_id", F.lit(0 if top is None else top + 1).cast("long") + F.monotonically_increasing_id())
        docs = docs.where("own_id is not null").unionByName(cut(numbered, "nameless"))
    found = minhash.near_duplicates(docs, "own_id", "own_text")
    return without(docs, found.where("not kept").select(F.col("doc_id").alias("id")), "own_id").select("doc.*")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind in angle brackets. Null texts and ids stay as they are."""
    found = pii.personal_spans(docs).where(F.size("spans") > 0)
    # equal texts have equal spans, so the text's hash tells rows of a repeated id apart
    found = found.select(F.struct("doc_id", "digest").alias("key"), "spans").dropDuplicates(["key"]).select("key", "spans")
    # documents stay in one struct, whatever their columns are called
    whole = docs.select(F.struct("*").alias("doc"))
    both = whole.join(found, F.col("doc.doc_id").eqNullSafe(F.col("key.doc_id")) & (F.xxhash64("doc.text") == F.col("key.digest")), "left")
    clean = both.withColumn("clean", F.when(F.col("spans").isNotNull(), pii.redacted(F.col("doc.text"), F.col("spans"))))
    put = {"text": F.coalesce("clean", "doc.text")}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.coalesce(F.length("clean").cast(docs.schema["n_chars"].dataType), "doc.n_chars")
    return clean.select(*[put.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in sequences of 1024 ids."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("quality", good), ("near_duplicates", unique), ("personal_data", private), ("packing", packed)]
#: Quality and language scores are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
