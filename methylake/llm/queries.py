"""One query per training-data operator: thin wrappers that apply it to its whole table and derive the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc(col: str = "doc_id"):
    return F.crc32(F.col(col).cast("string"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from methylake.llm import langid

    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc() % 4 == 2, F.lit(False)))
    protos = langid.train(docs.where("not held_out"))
    return langid.predict(docs, protos, keep=("doc_id", "held_out"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from methylake.llm import pii

    return pii.extract(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    from methylake.llm import bpe

    return bpe.digest_table(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_50k.json"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from methylake.llm import substring_dedup

    return substring_dedup.remove_repeated(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from methylake.llm import suffix_dedup

    return suffix_dedup.remove_repeated(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from methylake.llm import decontam

    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").alias("n_items"), "items", F.coalesce(F.array_max("shares"), F.lit(0.0)).alias("best_share"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from methylake.llm import jaccard_join

    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from methylake.llm import toxicity

    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc() % 3 == 1, F.lit(False)))
    labels = table(spark, sf_dir, "labels").where(crc() % 3 != 1).where("toxic is not null").select("doc_id", "toxic")
    model = toxicity.fit(toxicity.sample(docs, labels))
    return toxicity.score(docs, model, keep=("doc_id", "held_out"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from methylake.llm import warc

    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from methylake.llm import embed_dedup

    return embed_dedup.near(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express; the others are tested against brute force, round trips or held-out labels."""
    from methylake.llm import oracles

    return {"op4_substring_dedup": oracles.REMOVED_WORDS, "op6_warc": oracles.CAPTURES, "op7_embedding_dedup": oracles.NEAR_VECTORS, "op9_jaccard_join": oracles.NEAR_TEXTS, "op10_suffix_dedup": oracles.REMOVED_BYTES}
