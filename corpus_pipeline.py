"""Training-data pipeline over the documents table: language ID, near-duplicate removal, decontamination, PII redaction, BPE.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which run() writes as Parquet in the shared scratch folder and reads again as
the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methylake.llm import bpe, decontam, jaccard_join, langid, pii
from methylake.llm.common import Workspace, packed

#: A text of this many characters whose best cosine stays below MIN_SCORE is in none of the languages.
MIN_CHARS, MIN_SCORE = 40, 0.15
#: SQL can express none of the stages' rows (hypervectors, MinHash, SVD, BPE); tests compare them with brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts in no known language; fills lang where it is null.

    Languages are learnt from the rows that have one. Null and empty texts have no letters.
    A text of MIN_CHARS characters or more is in no known language if its best cosine stays
    below MIN_SCORE; shorter ones are too short to tell and stay. Without any row that has a
    language nothing can be told, and every text with letters stays. Repeated rows all stay
    or all go; of tied languages the first by name holds; long texts are judged whole.
    """
    protos = langid.train(docs)
    if not protos:
        return docs.where(F.col("text").rlike(r"\pL"))
    told = langid.predict(docs.select(packed(docs.columns).alias("row"), "text"), protos, keep=("row",))
    foreign = (F.char_length("row.text") >= MIN_CHARS) & (F.col("score") < MIN_SCORE)
    kept = told.where((F.col("lang_pred") != "und") & ~foreign)
    return kept.select(*(F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (the least doc_id, ids before nulls) stays.

    Groups are what links of five-word Jaccard similarity 0.8 or more connect; repeated rows
    and copies are groups too. Null texts and texts without words link with nothing and stay.
    """
    return jaccard_join.dedupe(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null and empty texts hold none; repeated rows all stay or all go; an empty benchmark
    drops nothing. Columns that the stage only carries stay packed, out of the way of its names.
    """
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rest = [c for c in docs.columns if c != "text"]
    found = decontam.scan(docs.select(packed(rest).alias("rest"), "text"), bench, keep=("rest",)).where(F.size("items") == 0)
    return found.select(*(F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets by their kind in brackets; n_chars follows the text (null with a null text). No row goes; repeated rows stay equal."""
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the token ids of each text, and the digest of the text that they decode to.

    Null texts are empty: no ids. Every row stays, repeated ones too; other columns go.
    """
    out = bpe.encode_table(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id", "lang", "source"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", redaction),
    ("bpe", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.put(stage(spark, docs, sf_dir), name)
        if k:
            ws.drop(STAGES[k - 1][0])
        ws.free()
    return docs
