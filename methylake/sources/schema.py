"""Column contract of the three tables of a cohort, and locus keys.

calls:   sample_id, chr, start, end, strand, context, methylated, unmethylated, coverage, beta
sites:   chr, start, end, strand, context (+ annotation columns); key (chr, start, end)
samples: sample_id (+ metadata)

A cell without a row in calls means coverage 0, methylated 0, beta NULL. Coordinates are
0-based and half-open; beta is a percentage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["chr", "start", "end"]
CALL_COLUMNS = ["sample_id", "chr", "start", "end", "strand", "context", "methylated", "unmethylated", "coverage", "beta"]
CONTEXTS = ("CpG", "CHG", "CHH")


def chr_ord(c: str = "chr") -> Column:
    """Genomic order: 1..22, X 23, Y 24, M or MT 25, all others 99."""
    name = F.upper(F.regexp_replace(c, "(?i)^chr", ""))
    number = F.when(name.rlike("^[0-9]{1,2}$"), name.cast("int"))
    return F.when(number.between(1, 22), number).when(name == "X", 23).when(name == "Y", 24).when(name.isin("M", "MT"), 25).otherwise(99)


def locus_id(c: str = "chr", start: str = "start") -> Column:
    """The encoded locus: chromosome number * 10^10 + start."""
    return chr_ord(c).cast("long") * F.lit(10**10) + F.col(start)


def locus_chr(locus: Column) -> Column:
    """Chromosome name of an encoded locus (MT for 25, Un for unknown ones)."""
    n = F.floor(locus / F.lit(10**10))
    name = F.when(n.between(1, 22), n.cast("string")).when(n == 23, "X").when(n == 24, "Y").when(n == 25, "MT").otherwise("Un")
    return F.concat(F.lit("chr"), name)


def locus_start(locus: Column) -> Column:
    return F.pmod(locus, F.lit(10**10))


def percent(methylated: Column, coverage: Column) -> Column:
    """100 * methylated / coverage; NULL without coverage."""
    return F.try_divide(methylated * F.lit(100.0), coverage)


def ordinal(sites: DataFrame, name: str = "locus_ix") -> DataFrame:
    """sites with their place 0..n-1 in genomic order: numbered per chromosome, moved by the sizes of the chromosomes before (a row each, broadcast)."""
    order = W.partitionBy("chr").orderBy("start", "end")
    sizes = sites.groupBy("chr").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.orderBy(chr_ord(), "chr").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("chr", F.coalesce(before, F.lit(0)).alias("__before"))
    return sites.join(F.broadcast(offsets), "chr").withColumn(name, F.row_number().over(order) - 1 + F.col("__before")).drop("__before")
