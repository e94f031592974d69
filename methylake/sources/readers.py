"""Readers of per-sample call files, BED regions and sample sheets: lazy plans with fixed schemas."""

from __future__ import annotations

import csv
import io
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methylake.operators import intervals
from methylake.operators.cohort import MethylFrame
from methylake.sources.schema import CALL_COLUMNS, ordinal, percent

STANDARD = ["chr", "start", "end", "strand", "beta", "methylated", "unmethylated", "coverage", "context"]


def require(spark: SparkSession, path: str) -> None:
    """FileNotFoundError if nothing matches path (any file system that Spark reads)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    if not found:
        raise FileNotFoundError(path)


def covered(df: DataFrame, low: int | None, high: int | None) -> DataFrame:
    if low is not None:
        df = df.where(F.col("coverage") >= low)
    return df if high is None else df.where(F.col("coverage") <= high)


def within(df: DataFrame, regions) -> DataFrame:
    return df if regions is None else intervals.contained(df, intervals.regions(df.sparkSession, regions))


def rescale(value, scale: str = "auto"):
    """Betas as percentages. auto: values up to 1 count as fractions, row by row."""
    if scale == "percent":
        return value
    if scale == "fraction":
        return value * 100
    if scale != "auto":
        raise ValueError(f"unknown beta scale {scale!r}")
    return F.when(value <= 1.0, value * 100).otherwise(value)


def read_bismark_coverage(spark: SparkSession, path: str, *, min_coverage: int = 1, max_coverage: int | None = None, context: str | None = None, regions=None) -> DataFrame:
    """Six columns without header: chr, start, end, beta, methylated, unmethylated. context is accepted for symmetry; the format has none."""
    require(spark, path)
    raw = spark.read.csv(path, sep="\t", schema="chr string, start bigint, end bigint, beta double, methylated bigint, unmethylated bigint")
    df = raw.withColumn("coverage", F.col("methylated") + F.col("unmethylated"))
    return within(covered(df, min_coverage, max_coverage), regions)


def read_bismark_cx_report(spark: SparkSession, path: str, *, min_coverage: int = 1, max_coverage: int | None = None, context: str | None = "CpG", regions=None) -> DataFrame:
    """Seven columns without header: chr, 1-based position, strand, methylated, unmethylated, context, trinucleotide."""
    require(spark, path)
    raw = spark.read.csv(path, sep="\t", schema="chr string, position bigint, strand string, methylated bigint, unmethylated bigint, context string, trinucleotide string")
    if context is not None:
        raw = raw.where(F.col("context") == context)
    df = raw.withColumns({"start": F.col("position") - 1, "end": F.col("position"), "coverage": F.col("methylated") + F.col("unmethylated")})
    df = covered(df, min_coverage, max_coverage).withColumn("beta", percent(F.col("methylated"), F.col("coverage")))
    return within(df.select(*STANDARD, "trinucleotide"), regions)


def read_bedgraph(spark: SparkSession, path: str, *, value_col: str = "beta", min_coverage: int = 1, sep: str = "\t", has_header: bool = False, regions=None, beta_scale: str = "auto") -> DataFrame:
    """chr, start, end, value. There are no counts, so min_coverage can't apply."""
    require(spark, path)
    df = spark.read.csv(path, sep=sep, header=has_header, enforceSchema=True, schema=f"chr string, start bigint, end bigint, `{value_col}` double")
    return within(df.withColumn(value_col, rescale(F.col(value_col), beta_scale)), regions)


def read_generic_methylation(
    spark: SparkSession,
    path: str,
    *,
    chr_col: str = "chr",
    start_col: str = "start",
    end_col: str = "end",
    beta_col: str | None = "beta",
    methylated_col: str | None = None,
    unmethylated_col: str | None = None,
    coverage_col: str | None = None,
    strand_col: str | None = None,
    context_col: str | None = None,
    sep: str = "\t",
    has_header: bool = True,
    comment_char: str = "#",
    min_coverage: int | None = 1,
    max_coverage: int | None = None,
    regions=None,
    beta_scale: str = "auto",
) -> DataFrame:
    """Any delimited table: columns are named by the caller, missing ones derived; standard columns first, others after."""
    require(spark, path)
    raw = spark.read.csv(path, sep=sep, header=has_header, comment=comment_char or None)
    names = {chr_col: "chr", start_col: "start", end_col: "end", beta_col: "beta", methylated_col: "methylated", unmethylated_col: "unmethylated", coverage_col: "coverage", strand_col: "strand", context_col: "context"}
    names = {k: v for k, v in names.items() if k}
    missing = [c for c in (chr_col, start_col, end_col) if c not in raw.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing")
    df = raw.withColumnsRenamed({k: v for k, v in names.items() if k in raw.columns})
    have = set(df.columns)
    typed = {c: F.col(c).try_cast("bigint") for c in ("start", "end", "methylated", "unmethylated", "coverage") if c in have}
    df = df.withColumns(typed | ({"beta": F.col("beta").try_cast("double")} if "beta" in have else {}))
    if "coverage" not in have and {"methylated", "unmethylated"} <= have:
        df = df.withColumn("coverage", F.col("methylated") + F.col("unmethylated"))
    if coverage_col and unmethylated_col is None and "methylated" in have:
        df = df.withColumn("unmethylated", F.col("coverage") - F.col("methylated"))
    if beta_col is None and {"methylated", "coverage"} <= set(df.columns):
        df = df.withColumn("beta", percent(F.col("methylated"), F.col("coverage")))
    if "beta" in df.columns:
        df = df.withColumn("beta", rescale(F.col("beta"), beta_scale))
    for c, default in (("strand", "*"), ("context", "CpG")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(default))
    if "coverage" in df.columns:
        df = covered(df, min_coverage, max_coverage)
    first = [c for c in STANDARD if c in df.columns]
    return within(df.select(*first, *[c for c in df.columns if c not in first]), regions)


def read_bed_regions(spark: SparkSession, path: str) -> DataFrame:
    """First three columns of a BED file; # starts a comment."""
    require(spark, path)
    raw = spark.read.csv(path, sep="\t", comment="#")
    return raw.select(F.col("_c0").alias("chr"), F.col("_c1").cast("bigint").alias("start"), F.col("_c2").cast("bigint").alias("end"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a BED file: chr, start, end, column_4.. and bed_row, the order of its lines."""
    require(spark, path)
    raw = spark.read.csv(path, sep="\t", comment="#").withColumn("bed_row", F.monotonically_increasing_id())
    more = [F.col(c).alias(f"column_{int(c[2:]) + 1}") for c in raw.columns if c.startswith("_c") and int(c[2:]) > 2]
    return raw.select(F.col("_c0").alias("chr"), F.col("_c1").cast("bigint").alias("start"), F.col("_c2").cast("bigint").alias("end"), *more, "bed_row")


def read_table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A delimited result table with header."""
    require(spark, path)
    return spark.read.csv(path, sep=sep, header=True, inferSchema=True)


def detect_format(path: str) -> str:
    """cx, bismark, bedgraph or generic, by the file's name; .gz is looked through."""
    name = path.rsplit("/", 1)[-1].lower().removesuffix(".gz")
    if "cx_report" in name:
        return "cx"
    if name.endswith(".cov"):
        return "bismark"
    return "bedgraph" if name.endswith((".bedgraph", ".bdg")) else "generic"


READERS = {"bismark": read_bismark_coverage, "cx": read_bismark_cx_report, "bedgraph": read_bedgraph, "generic": read_generic_methylation}


def load_sample(spark: SparkSession, path: str, fmt: str | None = None, *, min_coverage: int = 1, max_coverage: int | None = None, context: str | None = None, regions=None, **reader_kwargs) -> DataFrame:
    """One sample's calls in the standard columns, by the reader of its format."""
    fmt = fmt or detect_format(path)
    if fmt not in READERS:
        raise ValueError(f"unknown format {fmt!r}")
    if fmt != "bedgraph":
        reader_kwargs = {"max_coverage": max_coverage} | reader_kwargs
    if fmt == "cx" and context:
        reader_kwargs["context"] = context
    df = READERS[fmt](spark, path, min_coverage=min_coverage, regions=regions, **reader_kwargs)
    for c, default in (("strand", F.lit("*")), ("context", F.lit("CpG")), ("methylated", F.lit(None).cast("bigint")), ("unmethylated", F.lit(None).cast("bigint")), ("coverage", F.lit(None).cast("bigint")), ("beta", F.lit(None).cast("double"))):
        if c not in df.columns:
            df = df.withColumn(c, default)
    if context and fmt in ("cx", "generic"):
        df = df.where(F.col("context") == context)
    return df.select(*[c for c in CALL_COLUMNS if c != "sample_id"])


def read_sheet(spark: SparkSession, path: str) -> list[dict[str, str]]:
    """Rows of a sample sheet; sample_id and path are required and every path must exist."""
    require(spark, path)
    text = "\n".join(r[0] for r in spark.read.text(path).collect())
    rows = list(csv.DictReader(io.StringIO(text)))
    head = next(csv.reader(io.StringIO(text)), [])
    if missing := {"sample_id", "path"} - set(head):
        raise ValueError(f"the sample sheet lacks {sorted(missing)}")
    for r in rows:
        require(spark, r["path"])
    return rows


def read_samples(spark: SparkSession, sheet: str, *, min_coverage: int = 1, max_coverage: int | None = None, context: str | None = None, fmt: str | None = None, join_type: str = "outer", reader_kwargs: dict | None = None, regions_bed=None, output: str = "memory", out_path: str | None = None, validate_output: bool = False) -> MethylFrame:
    """Sample sheet -> cohort, as one lazy plan over all files; output='parquet' also stores it."""
    from methylake.sources import sinks

    if output not in ("memory", "parquet"):
        raise ValueError(f"unknown output {output!r}")
    if output == "parquet" and out_path is None:
        raise ValueError("out_path is needed")
    rows = read_sheet(spark, sheet)
    frames = []
    for r in rows:
        try:
            frames.append(load_sample(spark, r["path"], fmt, min_coverage=min_coverage, max_coverage=max_coverage, context=context, regions=regions_bed, **(reader_kwargs or {})))
        except (ValueError, TypeError, FileNotFoundError) as e:
            raise RuntimeError(f"sample {r['sample_id']}: {e}") from e
    meta = [{k: v for k, v in r.items() if k != "path"} for r in rows]
    cohort = build_cohort(spark, [r["sample_id"] for r in rows], frames, meta, join_type=join_type)
    if output == "parquet":
        sinks.save(cohort, out_path)
        cohort = sinks.load(spark, out_path)
        if validate_output:
            sinks.validate(cohort)
    return cohort


def build_cohort_streaming(spark: SparkSession, sample_ids: list[str], paths: list[str], metadata: list[dict] | None = None, *, min_coverage: int = 1, max_coverage: int | None = None, join_type: str = "outer", regions_bed=None) -> MethylFrame:
    """Coverage files -> cohort whose sites have locus_id, their place 0.. in genomic order. One lazy plan, like build_cohort: Spark reads files piece by piece in any case."""
    frames = [load_sample(spark, p, "bismark", min_coverage=min_coverage, max_coverage=max_coverage, regions=regions_bed) for p in paths]
    cohort = build_cohort(spark, sample_ids, frames, metadata, join_type=join_type)
    return replace(cohort, sites=ordinal(cohort.sites, "locus_id"))


def read_samples_streaming(spark: SparkSession, sheet: str, **how) -> MethylFrame:
    """Sample sheet of coverage files -> cohort, by build_cohort_streaming."""
    rows = read_sheet(spark, sheet)
    meta = [{k: v for k, v in r.items() if k != "path"} for r in rows]
    return build_cohort_streaming(spark, [r["sample_id"] for r in rows], [r["path"] for r in rows], meta, **how)


def build_cohort(spark: SparkSession, sample_ids: list[str], frames: list[DataFrame], metadata: list[dict] | None = None, *, join_type: str = "outer") -> MethylFrame:
    """Aligns samples on (chr, start): outer keeps the union of loci, inner those that every sample has.

    Counts of one sample's repeated loci are summed; a locus keeps its strand if all rows
    agree (else '*') and its least context; its end is start + 1.
    """
    if not frames:
        raise ValueError("no samples")
    if len(frames) != len(sample_ids) or metadata and len(metadata) != len(sample_ids):
        raise ValueError("samples, frames and metadata differ in number")
    if join_type not in ("outer", "inner"):
        raise ValueError(f"unknown join_type {join_type!r}")
    calls = None
    for s, f in zip(sample_ids, frames, strict=True):
        own = f.withColumn("sample_id", F.lit(s)).select(*CALL_COLUMNS)
        calls = own if calls is None else calls.unionByName(own)
    calls = calls.groupBy("sample_id", "chr", "start").agg(
        (F.col("start") + 1).alias("end"),
        F.when(F.min("strand") == F.max("strand"), F.min("strand")).otherwise("*").alias("strand"),
        F.min("context").alias("context"),
        F.sum("methylated").alias("methylated"),
        F.sum("unmethylated").alias("unmethylated"),
        F.sum("coverage").alias("coverage"),
        F.avg("beta").alias("beta"),
    )
    calls = calls.withColumn("beta", F.coalesce(percent(F.col("methylated"), F.col("coverage")), F.col("beta")))
    sites = calls.groupBy("chr", "start", "end").agg(F.when(F.min("strand") == F.max("strand"), F.min("strand")).otherwise("*").alias("strand"), F.min("context").alias("context"), F.count(F.lit(1)).alias("__n"))
    if join_type == "inner":
        sites = sites.where(F.col("__n") == len(frames))
        calls = calls.join(sites.select("chr", "start", "end"), ["chr", "start", "end"], "left_semi")
    samples = spark.createDataFrame([{"sample_id": s} | (m or {}) for s, m in zip(sample_ids, metadata or [None] * len(sample_ids), strict=True)])
    return MethylFrame(calls.select(*CALL_COLUMNS), sites.drop("__n"), samples)


#: The chunked entry point: the plan is the same, as Spark never holds a cohort at once.
build_cohort_chunked = build_cohort
