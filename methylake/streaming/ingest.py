"""Continuous ingestion: call files that arrive in a folder are appended to a cohort store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methylake.sources.schema import CALL_COLUMNS, percent

COVERAGE_SCHEMA = "chr string, start bigint, end bigint, beta double, methylated bigint, unmethylated bigint"


def call_stream(spark: SparkSession, folder: str, *, min_coverage: int = 1, max_files: int = 100) -> DataFrame:
    """Stream of calls from coverage files; the file's name up to its first dot is the sample."""
    raw = spark.readStream.schema(COVERAGE_SCHEMA).option("sep", "\t").option("maxFilesPerTrigger", max_files).csv(folder)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[^/]*$", 1)
    cov = F.col("methylated") + F.col("unmethylated")
    df = raw.select(name.alias("sample_id"), "chr", "start", "end", F.lit("*").alias("strand"), F.lit("CpG").alias("context"), "methylated", "unmethylated", cov.alias("coverage"), percent(F.col("methylated"), cov).alias("beta"))
    return df.where(F.col("coverage") >= min_coverage).select(*CALL_COLUMNS)


def append(stream: DataFrame, store: str, checkpoint: str, *, available_now: bool = True):
    """Appends the stream to store/calls by chromosome, exactly once through the file sink's log."""
    w = stream.writeStream.format("parquet").option("path", f"{store}/calls").option("checkpointLocation", checkpoint).partitionBy("chr").outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()
