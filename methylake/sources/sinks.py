"""Stores and exports: cohorts as Parquet by chromosome, regions as BED, results as TSV."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methylake.operators.cohort import MethylFrame

TABLES = ("calls", "sites", "samples")


def save(cohort: MethylFrame, path: str, format: str = "parquet") -> None:
    """Overwrites a store: calls and sites by chromosome, samples, and a line of metadata."""
    if format != "parquet":
        raise ValueError(f"unknown format {format!r}")
    for name in TABLES:
        df = getattr(cohort, name)
        if len(set(map(str.lower, df.columns))) < len(df.columns):
            raise ValueError(f"{name} has clashing columns {df.columns}")
        w = df.write.mode("overwrite")
        (w.partitionBy("chr") if "chr" in df.columns else w).parquet(f"{path}/{name}")
    note = json.dumps({"tables": TABLES, "samples": cohort.n_samples})
    cohort.samples.sparkSession.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> MethylFrame:
    """Opens a store lazily."""
    from methylake.sources.readers import require

    require(spark, f"{path}/calls")
    return MethylFrame(*(_typed(spark.read.parquet(f"{path}/{t}")) for t in TABLES))


def validate(cohort: MethylFrame) -> None:
    """RuntimeError unless every call has its site and its sample, no (sample, site) occurs twice, and counts add up."""
    key = ["sample_id", "chr", "start", "end"]
    calls = cohort.calls
    faults = {
        "calls without a site": calls.join(cohort.sites, key[1:], "left_anti"),
        "calls without a sample": calls.join(F.broadcast(cohort.samples.select("sample_id")), "sample_id", "left_anti"),
        "repeated calls": calls.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
        "counts that don't add up": calls.where("methylated < 0 or unmethylated < 0 or methylated + unmethylated <> coverage"),
    }
    if wrong := [name for name, df in faults.items() if not df.isEmpty()]:
        raise RuntimeError(f"the store has {', '.join(wrong)}")


def _typed(df: DataFrame) -> DataFrame:
    return df.withColumn("chr", F.col("chr").cast("string")) if "chr" in df.columns else df


def dmr_bed(dmrs: DataFrame, *, score_col: str = "mean_diff", name_col: str = "direction") -> DataFrame:
    """Six BED columns: the score is |score_col| * 10 cut to 0..1000 (0 without the column), the name DMR without one, strand '.'."""
    score = F.least(F.greatest(F.abs(F.col(score_col)) * 10, F.lit(0.0)), F.lit(1000.0)).cast("int") if score_col in dmrs.columns else F.lit(0)
    name = F.col(name_col) if name_col in dmrs.columns else F.lit("DMR")
    return dmrs.select("chr", "start", "end", name.alias("name"), F.coalesce(score, F.lit(0)).alias("score"), F.lit(".").alias("strand"))


def dmrs_to_bed(dmrs: DataFrame, path: str, *, score_col: str = "mean_diff", name_col: str = "direction", include_header: bool = False) -> None:
    dmr_bed(dmrs, score_col=score_col, name_col=name_col).orderBy("chr", "start").coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=include_header)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)
