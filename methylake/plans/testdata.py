"""A methylation cohort derived from the star-schema tables by integer arithmetic that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methylake.operators.cohort import MethylFrame

RAW = """
SELECT concat('s', CAST(l_suppkey % 6 AS STRING)) AS sample_id,
       concat('chr', CAST(1 + l_partkey % 22 AS STRING)) AS chr,
       (l_partkey div 22) * 350 + (l_linenumber % 2) * 40 AS start,
       CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS strand,
       CASE WHEN l_partkey % 10 < 8 THEN 'CpG' WHEN l_partkey % 10 = 8 THEN 'CHG' ELSE 'CHH' END AS context,
       CAST(l_quantity AS BIGINT) AS qty,
       (l_orderkey * 37 + l_linenumber * 11) % 41 + 20 + CASE WHEN l_suppkey % 2 = 1 AND (l_partkey div 22) % 10 < 3 THEN 35 ELSE 0 END AS pct
FROM {lineitem}
"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.sql(RAW.format(lineitem="{src}"), src=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    d = raw.groupBy("sample_id", "chr", "start", "strand", "context").agg(F.sum(F.expr("(qty * pct) div 100")).alias("methylated"), F.sum("qty").alias("coverage"))
    return d.select("sample_id", "chr", "start", (F.col("start") + 1).alias("end"), "strand", "context", "methylated", (F.col("coverage") - F.col("methylated")).alias("unmethylated"), "coverage", (F.col("methylated") * 100.0 / F.col("coverage")).alias("beta"))


def samples(spark: SparkSession) -> DataFrame:
    return spark.range(6).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("sample_id"), F.when(F.col("id") % 2 == 0, "control").otherwise("treated").alias("group"), F.when(F.col("id") < 3, "A").otherwise("B").alias("batch"), F.col("id").cast("double").alias("age"))


def cohort(spark: SparkSession, sf_dir: str) -> MethylFrame:
    c = calls(spark, sf_dir)
    sites = c.groupBy("chr", "start", "end").agg(F.min("strand").alias("strand"), F.min("context").alias("context"))
    return MethylFrame(c, sites, samples(spark))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 3 <> 2")
    start = F.expr("(p_partkey div 22) * 350")
    return p.select(F.expr("concat('chr', CAST(1 + p_partkey % 22 AS STRING))").alias("chr"), start.alias("start"), (start + F.col("p_size") * 10).alias("end"), F.col("p_brand").alias("name"), F.col("p_partkey").alias("bed_row"))


def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey % 3 = 0")
    return s.select(F.expr("concat('chr', CAST(1 + s_suppkey % 22 AS STRING))").alias("chr"), (F.col("s_suppkey") * 300).alias("start"), (F.col("s_suppkey") * 300 + 1000).alias("end"))


#: The same tables as DuckDB common table expressions.
CTE = """WITH raw AS (
  SELECT 's' || (l_suppkey % 6) AS sample_id, 'chr' || (1 + l_partkey % 22) AS chr,
         CAST((l_partkey // 22) * 350 + (l_linenumber % 2) * 40 AS BIGINT) AS "start",
         CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS strand,
         CASE WHEN l_partkey % 10 < 8 THEN 'CpG' WHEN l_partkey % 10 = 8 THEN 'CHG' ELSE 'CHH' END AS context,
         CAST(l_quantity AS BIGINT) AS qty,
         (l_orderkey * 37 + l_linenumber * 11) % 41 + 20 + CASE WHEN l_suppkey % 2 = 1 AND (l_partkey // 22) % 10 < 3 THEN 35 ELSE 0 END AS pct
  FROM lineitem),
calls AS (
  SELECT sample_id, chr, "start", "start" + 1 AS "end", strand, context, CAST(SUM((qty * pct) // 100) AS BIGINT) AS methylated,
         CAST(SUM(qty) AS BIGINT) AS coverage, SUM((qty * pct) // 100) * 100.0 / SUM(qty) AS beta,
         CASE WHEN sample_id IN ('s0', 's2', 's4') THEN 'control' ELSE 'treated' END AS grp
  FROM raw GROUP BY sample_id, chr, "start", strand, context),
sites AS (SELECT chr, "start", "end", MIN(strand) AS strand, MIN(context) AS context FROM calls GROUP BY chr, "start", "end"),
features AS (SELECT 'chr' || (1 + p_partkey % 22) AS chr, CAST((p_partkey // 22) * 350 AS BIGINT) AS "start", CAST((p_partkey // 22) * 350 + p_size * 10 AS BIGINT) AS "end", p_brand AS name, p_partkey AS bed_row FROM part WHERE p_partkey % 3 <> 2),
islands AS (SELECT 'chr' || (1 + s_suppkey % 22) AS chr, s_suppkey * 300 AS "start", s_suppkey * 300 + 1000 AS "end" FROM supplier WHERE s_suppkey % 3 = 0)
"""
