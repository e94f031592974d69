"""Regions of neighbouring significant sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge_dmrs(dmc: DataFrame, *, qvalue_cutoff: float = 0.05, mean_diff_cutoff: float = 0.0, max_gap: int = 1000, min_sites: int = 3, min_abs_diff: float = 10.0, same_direction: bool = True) -> DataFrame:
    """Sessions of significant sites per chromosome: a gap over max_gap or a change of sign starts a new one.

    Rows: chr, start, end (of the last site), n_cpgs, mean_diff, min_qvalue, direction. Sites
    without a difference are left out.
    """
    if missing := {"chr", "start", "end", "qvalue", "mean_diff"} - set(dmc.columns):
        raise ValueError(f"columns {sorted(missing)} are missing")
    d = dmc.where((F.col("qvalue") < qvalue_cutoff) & F.col("mean_diff").isNotNull())
    if mean_diff_cutoff > 0:
        d = d.where(F.abs("mean_diff") >= mean_diff_cutoff)
    by = W.partitionBy("chr").orderBy("start", "end")
    new = F.lag("end").over(by).isNull() | (F.col("start") - F.lag("end").over(by) > max_gap)
    if same_direction:
        new = new | (F.signum("mean_diff") != F.lag(F.signum("mean_diff")).over(by))
    d = d.withColumn("new", new.cast("int")).withColumn("rn", F.row_number().over(by))
    d = d.withColumn("island", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    out = d.groupBy("chr", "island").agg(F.min("start").alias("start"), F.max_by("end", "rn").alias("end"), F.count(F.lit(1)).alias("n_cpgs"), F.avg("mean_diff").alias("mean_diff"), F.min("qvalue").alias("min_qvalue"))
    out = out.where((F.col("n_cpgs") >= min_sites) & (F.abs("mean_diff") >= min_abs_diff))
    return out.withColumn("direction", F.when(F.col("mean_diff") > 0, "hyper").otherwise("hypo")).drop("island")


def filter_dmrs(dmrs: DataFrame, *, direction: str | None = None, min_n_cpgs: int = 1, min_abs_diff: float = 0.0, max_qvalue: float = 1.0, chromosomes: list[str] | None = None) -> DataFrame:
    out = dmrs.where((F.col("n_cpgs") >= min_n_cpgs) & (F.abs("mean_diff") >= min_abs_diff) & (F.col("min_qvalue") <= max_qvalue))
    if direction is not None:
        out = out.where(F.col("direction") == direction)
    return out if chromosomes is None else out.where(F.col("chr").isin(list(chromosomes)))


def top(dmc: DataFrame, k: int, *, hyper: bool = True) -> DataFrame:
    """The k sites of the largest (smallest) difference; ties in genomic order."""
    return dmc.where("mean_diff is not null").orderBy(F.desc("mean_diff") if hyper else F.asc("mean_diff"), "chr", "start", "end").limit(k)
