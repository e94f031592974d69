"""Interval algebra on half-open coordinates: merging, containment, overlap, windows, annotation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from methylake.operators.cohort import MethylFrame
from methylake.sources.schema import KEY, percent

BIN = 16_384


def merge(df: DataFrame) -> DataFrame:
    """Unions overlapping and touching intervals of a chromosome."""
    by = W.partitionBy("chr").orderBy("start", "end")
    seen = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    cut = df.select("chr", "start", "end").withColumn("new", F.when(seen.isNull() | (F.col("start") > seen), 1).otherwise(0))
    island = cut.withColumn("island", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy("chr", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("chr", "start", "end")


def regions(spark: SparkSession, source) -> DataFrame:
    """Merged regions from a BED path, a DataFrame or rows (chr, start, end)."""
    from methylake.sources.readers import read_bed_regions

    if isinstance(source, str):
        df = read_bed_regions(spark, source)
    elif isinstance(source, DataFrame):
        df = source
    else:
        df = spark.createDataFrame([tuple(r) for r in source], "chr string, start bigint, end bigint")
    return merge(df.select(F.col("chr").cast("string"), F.col("start").cast("bigint"), F.col("end").cast("bigint")))


def validate(df: DataFrame) -> None:
    """ValueError if an interval is negative or ends before it starts."""
    bad = df.where("start < 0 or end < 0 or end < start or start is null or end is null").limit(1).count()
    if bad:
        raise ValueError("intervals need 0 <= start <= end")


def _bins(lo, hi, width: int):
    a = F.floor(lo / width).cast("long")
    return F.sequence(a, F.greatest(a, F.floor(hi / width).cast("long")))


def contained(df: DataFrame, merged: DataFrame, width: int = BIN) -> DataFrame:
    """Rows whose start lies in a region. No regions, no rows. An equi-join on bins: each row has one, a region those that it spans."""
    r = merged.where("start < end").select(F.col("chr").alias("__chr"), F.col("start").alias("__lo"), F.col("end").alias("__hi"))
    r = r.withColumn("__bin", F.explode(_bins(F.col("__lo"), F.col("__hi") - 1, width)))
    on = (F.col("chr") == F.col("__chr")) & (F.floor(F.col("start") / width).cast("long") == F.col("__bin")) & (F.col("__lo") <= F.col("start")) & (F.col("start") < F.col("__hi"))
    return df.join(r, on, "left_semi")


def overlaps(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """Pairs of overlapping intervals: left's columns, right's with the prefix r_. Both are dealt to bins; a pair counts in the bin where its overlap starts."""
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("__bin", F.explode(_bins(F.col("r_start"), F.col("r_end") - 1, width)))
    x = left.withColumn("__bin", F.explode(_bins(F.col("start"), F.col("end") - 1, width)))
    on = (x["chr"] == r["r_chr"]) & (x["__bin"] == r["__bin"]) & (x["start"] < r["r_end"]) & (x["end"] > r["r_start"])
    both = x.join(r, on).where(x["__bin"] == F.floor(F.greatest(x["start"], r["r_start"]) / width).cast("long"))
    return both.drop("__bin")


def tile_counts(cohort: MethylFrame, window: int = 1000, step: int | None = None, min_cpgs_per_window: int = 1) -> MethylFrame:
    """Sums counts over windows [k step, min(k step + window, chromosome's end)). n_cpgs counts the sites that touch a window, covered or not.

    A window's number follows from the coordinates, so no interval join is needed.
    """
    step = step or window
    if window <= 0 or step <= 0:
        raise ValueError("window and step must be positive")
    lo = F.greatest(F.lit(0).cast("long"), (F.floor((F.col("start") - window) / step) + 1).cast("long"))
    hi = F.floor((F.col("end") - 1) / step).cast("long")
    tiles = lambda df: df.withColumns({"__lo": lo, "__hi": hi}).where("__lo <= __hi").withColumn("__k", F.explode(F.sequence("__lo", "__hi")))
    size = cohort.sites.groupBy("chr").agg(F.max("end").alias("__size"))
    n = tiles(cohort.sites).groupBy("chr", "__k").agg(F.count(F.lit(1)).alias("n_cpgs")).where(F.col("n_cpgs") >= min_cpgs_per_window)
    sites = n.join(size, "chr").select("chr", (F.col("__k") * step).alias("start"), F.least(F.col("__k") * step + window, "__size").alias("end"), "n_cpgs", "__k")
    sums = tiles(cohort.calls).groupBy("sample_id", "chr", "__k").agg(F.sum("methylated").alias("methylated"), F.sum("coverage").alias("coverage"))
    calls = sums.join(sites.drop("n_cpgs"), ["chr", "__k"]).select("sample_id", "chr", "start", "end", "methylated", (F.col("coverage") - F.col("methylated")).alias("unmethylated"), "coverage", percent(F.col("methylated"), F.col("coverage")).alias("beta"))
    return MethylFrame(calls, sites.drop("__k"), cohort.samples)


def tile_key(c: str = "chr", start: str = "start", end: str = "end"):
    return F.format_string("%s:%d-%d:*", F.col(c), F.col(start), F.col(end))


def _bed(sites: DataFrame, source) -> DataFrame:
    from methylake.sources.readers import read_bed

    return read_bed(sites.sparkSession, source) if isinstance(source, str) else source


def annotate_features(sites, bed, *, feature_col: str = "feature", name_col: str | int | None = None):
    """A cohort, or its sites, with the label of the first BED row that overlaps (NULL if none): its name column (a 1-based number works), else chr:start-end. bed is a path or a table."""
    if isinstance(sites, MethylFrame):
        return replace(sites, sites=annotate_features(sites.sites, bed, feature_col=feature_col, name_col=name_col))
    bed = _bed(sites, bed)
    name = f"column_{name_col}" if isinstance(name_col, int) else name_col
    label = F.col(name) if name else F.concat_ws("", "chr", F.lit(":"), "start", F.lit("-"), "end")
    if "bed_row" not in bed.columns:
        bed = bed.withColumn("bed_row", F.monotonically_increasing_id())
    b = bed.select("chr", "start", "end", "bed_row", label.cast("string").alias("label"))
    first = overlaps(sites.select(*KEY), b).groupBy(*KEY).agg(F.min_by("r_label", "r_bed_row").alias(feature_col))
    return sites.drop(feature_col).join(first, KEY, "left")


def annotate_cpg_islands(sites, islands, *, shore_distance: int = 2000, shelf_distance: int = 4000, region_col: str = "cpg_region"):
    """A cohort, or its sites, with island, shore, shelf or open_sea: one overlap join with the widest flanks, the nearest tier wins. islands is a path or a table."""
    if isinstance(sites, MethylFrame):
        return replace(sites, sites=annotate_cpg_islands(sites.sites, islands, shore_distance=shore_distance, shelf_distance=shelf_distance, region_col=region_col))
    islands = _bed(sites, islands)
    wide = islands.select("chr", F.greatest(F.lit(0).cast("long"), F.col("start") - max(shore_distance, shelf_distance)).alias("start"), (F.col("end") + max(shore_distance, shelf_distance)).alias("end"), F.col("start").alias("s"), F.col("end").alias("e"))

    def hit(d: int):
        return (F.col("start") < F.col("r_e") + d) & (F.col("end") > F.greatest(F.lit(0).cast("long"), F.col("r_s") - d))

    tier = F.when(hit(0), 0).when(hit(shore_distance), 1).when(hit(shelf_distance), 2)
    best = overlaps(sites.select(*KEY), wide).withColumn("tier", tier).groupBy(*KEY).agg(F.min("tier").alias("tier"))
    name = F.when(F.col("tier") == 0, "island").when(F.col("tier") == 1, "shore").when(F.col("tier") == 2, "shelf").otherwise("open_sea")
    return sites.drop(region_col).join(best, KEY, "left").withColumn(region_col, name).drop("tier")
