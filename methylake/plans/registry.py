"""Registered queries of the methylation engine and their SQL counterparts (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methylake.operators import dmr, intervals, qc, stats
from methylake.operators.cohort import MethylFrame
from methylake.plans import testdata
from methylake.plans.testdata import CTE
from methylake.sources import readers, schema, scratch, sinks

KEY = ["chr", "start", "end"]
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
K = 'chr, "start", "end"'


def query(sql: str | None = None, bare: bool = False):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if bare else CTE + sql
        return f

    return add


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def site_table(m: MethylFrame) -> DataFrame:
    return m.sites.select(*KEY, "strand", "context")


# --- scans and loci ----------------------------------------------------------------


@query(f"SELECT sample_id, {K}, methylated, coverage, ROUND(beta, 6) AS beta FROM calls WHERE coverage BETWEEN 10 AND 100")
def calls_filter_coverage_scan(spark, sf):
    c = testdata.calls(spark, sf).where(F.col("coverage").between(10, 100))
    return c.select("sample_id", *KEY, "methylated", "coverage", *r6("beta"))


@query("""SELECT chr, "start", CAST(CASE WHEN chr = 'chrX' THEN 23 ELSE CAST(substr(chr, 4) AS BIGINT) END * 10000000000 + "start" AS BIGINT) AS locus_id, chr AS back_chr, "start" AS back_start FROM sites""")
def locus_encode_decode(spark, sf):
    s = testdata.cohort(spark, sf).sites.select("chr", "start", schema.locus_id().alias("locus_id"))
    return s.select("*", schema.locus_chr(F.col("locus_id")).alias("back_chr"), schema.locus_start(F.col("locus_id")).alias("back_start"))


@query("""SELECT chr, "start", ROW_NUMBER() OVER (ORDER BY CAST(substr(chr, 4) AS INT), "start") - 1 AS locus_ix FROM sites""")
def locus_ordinal(spark, sf):
    return schema.ordinal(testdata.cohort(spark, sf).sites).select("chr", "start", "locus_ix")


@query("""SELECT chr, "start", "end", "start" // 1000 AS tier FROM sites EXCEPT SELECT s.chr, s."start", s."end", s."start" // 1000 FROM sites s JOIN features f ON s.chr = f.chr AND s."start" >= f."start" AND s."start" < f."end" """)
def loci_outside_features(spark, sf):
    s = testdata.cohort(spark, sf).sites.select(*KEY)
    inside = intervals.contained(s, intervals.regions(spark, testdata.features(spark, sf)))
    return s.join(inside, KEY, "left_anti").withColumn("tier", F.expr("start div 1000"))


@query(f"SELECT {K}, strand, context FROM sites WHERE (chr, \"start\") IN (SELECT (chr, \"start\") FROM calls GROUP BY chr, \"start\" HAVING COUNT(*) = 6)")
def cohort_inner_loci(spark, sf):
    return site_table(_built(spark, sf, "inner"))


def _built(spark, sf, join_type):
    c = testdata.calls(spark, sf)
    ids = [f"s{i}" for i in range(6)]
    return readers.build_cohort(spark, ids, [c.where(F.col("sample_id") == s).drop("sample_id") for s in ids], join_type=join_type)


@query(f"SELECT s.sample_id, {', '.join('t.' + k for k in ('chr', chr(34) + 'start' + chr(34), chr(34) + 'end' + chr(34)))}, COALESCE(c.methylated, 0) AS methylated, COALESCE(c.coverage, 0) AS coverage, ROUND(c.beta, 6) AS beta FROM sites t CROSS JOIN (SELECT 's' || i AS sample_id FROM range(6) r(i)) s LEFT JOIN calls c ON c.sample_id = s.sample_id AND c.chr = t.chr AND c.\"start\" = t.\"start\"")
def cohort_dense(spark, sf):
    return testdata.cohort(spark, sf).dense().select("sample_id", *KEY, "methylated", "coverage", *r6("beta"))


@query(f"SELECT sample_id, {K}, coverage - methylated AS unmethylated FROM calls")
def layer_unmethylated(spark, sf):
    return testdata.cohort(spark, sf).unmethylated


# --- files: written in scratch from the derived calls, read by the readers ----------------


def _written(spark, sf, df, suffix: str, header: bool = False) -> dict[str, str]:
    """A text file (folder) for each sample_id of df; paths by sample."""
    path = scratch.folder(spark, "calls")
    df.withColumn("file", F.concat("sample_id", F.lit(suffix))).drop("sample_id").write.partitionBy("file").csv(path, sep="\t", header=header, compression="gzip")
    return {f"s{i}": f"{path}/file=s{i}{suffix}" for i in range(6)}


def _read(paths: dict[str, str], read) -> DataFrame:
    out = None
    for s, p in paths.items():
        own = read(p).withColumn("sample_id", F.lit(s))
        out = own if out is None else out.unionByName(own)
    return out


def _coverage_files(spark, sf, suffix: str = ".cov") -> dict[str, str]:
    return _written(spark, sf, testdata.calls(spark, sf).select("sample_id", *KEY, "beta", "methylated", "unmethylated"), suffix)


_READ = f"SELECT sample_id, {K}, methylated, coverage - methylated AS unmethylated, coverage, ROUND({{}}, 6) AS beta FROM calls c WHERE {{}}"
_INSIDE = "EXISTS (SELECT 1 FROM features r WHERE r.chr = c.chr AND r.\"start\" <= c.\"start\" AND c.\"start\" < r.\"end\")"


@query(_READ.format("beta", f"coverage BETWEEN 10 AND 100 AND {_INSIDE}"))
def read_coverage_files(spark, sf):
    out = _read(_coverage_files(spark, sf), lambda p: readers.read_bismark_coverage(spark, p, min_coverage=10, max_coverage=100, regions=testdata.features(spark, sf)))
    return out.select("sample_id", *KEY, "methylated", "unmethylated", "coverage", *r6("beta"))


@query(_READ.format("beta", "coverage >= 5 AND context = 'CpG'").replace("coverage, ROUND", "coverage, strand, context, ROUND"))
def read_cx_files(spark, sf):
    c = testdata.calls(spark, sf).select("sample_id", "chr", "end", "strand", "methylated", "unmethylated", "context", F.lit("CGA").alias("trinucleotide"))
    out = _read(_written(spark, sf, c, ".CX_report.txt"), lambda p: readers.read_bismark_cx_report(spark, p, min_coverage=5))
    return out.select("sample_id", *KEY, "methylated", "unmethylated", "coverage", "strand", "context", *r6("beta"))


@query(f"SELECT sample_id, {K}, ROUND(CASE WHEN beta <= 1 THEN 100 * beta ELSE beta END, 6) AS beta FROM calls")
def read_bedgraph_files(spark, sf):
    c = testdata.calls(spark, sf).select("sample_id", *KEY, "beta")
    return _read(_written(spark, sf, c, ".bedgraph"), lambda p: readers.read_bedgraph(spark, p)).select("sample_id", *KEY, *r6("beta"))


@query(_READ.format("CASE WHEN beta <= 1 THEN 100 * beta ELSE beta END", "coverage BETWEEN 3 AND 150").replace("coverage, ROUND", "coverage, strand, context, CAST(qty AS VARCHAR) AS qty, ROUND").replace("FROM calls c", "FROM (SELECT *, coverage AS qty FROM calls) c"))
def read_generic_files(spark, sf):
    c = testdata.calls(spark, sf).select("sample_id", F.col("chr").alias("chrom"), F.col("start").alias("pos"), F.col("end").alias("stop"), F.col("methylated").alias("m"), F.col("coverage").alias("n"), F.col("strand").alias("dir"), F.col("context").alias("ctx"), F.col("coverage").alias("qty"))
    how = {"chr_col": "chrom", "start_col": "pos", "end_col": "stop", "beta_col": None, "methylated_col": "m", "coverage_col": "n", "strand_col": "dir", "context_col": "ctx", "min_coverage": 3, "max_coverage": 150}
    out = _read(_written(spark, sf, c, ".tsv", True), lambda p: readers.read_generic_methylation(spark, p, **how))
    return out.select("sample_id", *KEY, "methylated", "unmethylated", "coverage", "strand", "context", "qty", *r6("beta"))


def _bed(spark, df) -> str:
    path = scratch.folder(spark, "bed")
    df.coalesce(1).write.csv(path, sep="\t")
    return path


@query("SELECT chr, \"start\", \"end\", name AS column_4, CAST(CASE WHEN (SELECT COUNT(*) FROM features f WHERE f.\"start\" < 0 OR f.\"end\" < f.\"start\") = 0 THEN 1 ELSE 0 END AS INT) AS valid FROM features")
def read_bed_files(spark, sf):
    path = _bed(spark, testdata.features(spark, sf).select(*KEY, "name"))
    intervals.validate(readers.read_bed_regions(spark, path))
    return readers.read_bed(spark, path).select(*KEY, "column_4", F.lit(1).alias("valid"))


@query("SELECT s.chr, s.\"start\", s.\"end\", (SELECT MIN_BY(f.name, f.bed_row) FROM features f WHERE s.chr = f.chr AND s.\"start\" < f.\"end\" AND s.\"end\" > f.\"start\") AS feature FROM sites s")
def annotate_cohort_by_file(spark, sf):
    path = _bed(spark, testdata.features(spark, sf).orderBy("bed_row").select(*KEY, "name"))
    return intervals.annotate_features(testdata.cohort(spark, sf), path, name_col=4).sites.select(*KEY, "feature")


def _sheet(spark, sf) -> str:
    """A sample sheet of coverage files with metadata."""
    path = scratch.folder(spark, "sheet")
    lines = ["sample_id,path,group,age", *(f"{s},{p},{'control' if int(s[1]) % 2 == 0 else 'treated'},{30 + int(s[1])}" for s, p in _coverage_files(spark, sf).items())]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


_SHARED = "(chr, \"start\") IN (SELECT (chr, \"start\") FROM calls WHERE coverage >= 5 GROUP BY chr, \"start\" HAVING COUNT(*) = 6)"


@query(f"SELECT sample_id, {K}, '*' AS strand, 'CpG' AS context, methylated, coverage, ROUND(beta, 6) AS beta, grp AS \"group\", CAST(30 + CAST(substr(sample_id, 2) AS INT) AS VARCHAR) AS age FROM calls WHERE coverage >= 5")
def sheet_outer_cohort(spark, sf):
    m = readers.read_samples(spark, _sheet(spark, sf), min_coverage=5)
    return m.calls.join(m.samples, "sample_id").select("sample_id", *KEY, "strand", "context", "methylated", "coverage", *r6("beta"), "group", "age")


@query(f"SELECT sample_id, {K}, methylated, coverage, ROUND(beta, 6) AS beta FROM calls WHERE coverage >= 5 AND {_SHARED}")
def sheet_inner_stored(spark, sf):
    m = readers.read_samples(spark, _sheet(spark, sf), min_coverage=5, join_type="inner", output="parquet", out_path=scratch.folder(spark, "store"), validate_output=True)
    return m.calls.select("sample_id", *KEY, "methylated", "coverage", *r6("beta"))


@query("""SELECT chr, "start", "end", '*' AS strand, 'CpG' AS context, ROW_NUMBER() OVER (ORDER BY CAST(substr(chr, 4) AS INT), "start") - 1 AS locus_id FROM (SELECT DISTINCT chr, "start", "end" FROM calls WHERE coverage BETWEEN 5 AND 200)""")
def sheet_streaming_loci(spark, sf):
    return readers.read_samples_streaming(spark, _sheet(spark, sf), min_coverage=5, max_coverage=200).sites.select(*KEY, "strand", "context", "locus_id")


@query(f"SELECT {K}, strand, context, CAST((SELECT COUNT(*) FROM calls c WHERE c.chr = s.chr AND c.\"start\" = s.\"start\") AS BIGINT) AS n_samples FROM sites s")
def cohort_outer_loci(spark, sf):
    m = _built(spark, sf, "outer")
    return m.sites.join(m.calls.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_samples")), KEY).select(*KEY, "strand", "context", "n_samples")


# --- intervals -----------------------------------------------------------------------

_MERGED = """, marked AS (SELECT *, CASE WHEN "start" > MAX("end") OVER (PARTITION BY chr ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS brk FROM features),
numbered AS (SELECT *, SUM(brk) OVER (PARTITION BY chr ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM marked),
merged AS (SELECT chr, MIN("start") AS "start", MAX("end") AS "end" FROM numbered GROUP BY chr, island)
"""


@query(_MERGED + f"SELECT {K} FROM merged")
def regions_merge(spark, sf):
    return intervals.merge(testdata.features(spark, sf))


@query(f"SELECT sample_id, {K}, methylated, coverage FROM calls c WHERE EXISTS (SELECT 1 FROM features r WHERE r.chr = c.chr AND r.\"start\" <= c.\"start\" AND c.\"start\" < r.\"end\")")
def regions_filter(spark, sf):
    r = intervals.regions(spark, testdata.features(spark, sf))
    return intervals.contained(testdata.calls(spark, sf), r).select("sample_id", *KEY, "methylated", "coverage")


@query("SELECT s.chr, s.\"start\", s.\"end\", f.\"start\" AS r_start, f.\"end\" AS r_end, f.name AS r_name FROM sites s JOIN features f ON s.chr = f.chr AND s.\"start\" < f.\"end\" AND s.\"end\" > f.\"start\"")
def interval_overlap_join(spark, sf):
    m = testdata.cohort(spark, sf)
    return intervals.overlaps(m.sites.select(*KEY), testdata.features(spark, sf)).select(*KEY, "r_start", "r_end", "r_name")


@query("SELECT s.chr, s.\"start\", s.\"end\", s.strand, s.context, (SELECT MIN_BY(f.name, f.bed_row) FROM features f WHERE s.chr = f.chr AND s.\"start\" < f.\"end\" AND s.\"end\" > f.\"start\") AS feature FROM sites s")
def annotate_features(spark, sf):
    m = testdata.cohort(spark, sf)
    return intervals.annotate_features(m.sites, testdata.features(spark, sf), name_col="name")


@query("""SELECT s.chr, s."start", s."end", s.strand, s.context, COALESCE((SELECT MIN(CASE WHEN s."start" < i."end" AND s."end" > i."start" THEN '1island' WHEN s."start" < i."end" + 2000 AND s."end" > i."start" - 2000 THEN '2shore' ELSE '3shelf' END)
FROM islands i WHERE s.chr = i.chr AND s."start" < i."end" + 4000 AND s."end" > i."start" - 4000), '4open_sea')[2:] AS cpg_region FROM sites s""")
def annotate_cpg_islands(spark, sf):
    m = testdata.cohort(spark, sf)
    return intervals.annotate_cpg_islands(m.sites, testdata.islands(spark, sf))


def _tile_sql(window: int, step: int, least: int) -> str:
    span = f"""SELECT *, unnest(range(GREATEST(0, CAST(floor(("start" - {window}) / {step}.0) AS BIGINT) + 1), CAST(floor(("end" - 1) / {step}.0) AS BIGINT) + 1)) AS k"""
    return f"""SELECT c.sample_id, c.chr, c.k * {step} AS "start", LEAST(c.k * {step} + {window}, z.size) AS "end", n.n_cpgs,
CAST(SUM(methylated) AS BIGINT) AS methylated, CAST(SUM(coverage) AS BIGINT) AS coverage, ROUND(SUM(methylated) * 100.0 / SUM(coverage), 6) AS beta
FROM ({span} FROM calls) c JOIN (SELECT chr, k, COUNT(*) AS n_cpgs FROM ({span} FROM sites) GROUP BY chr, k HAVING COUNT(*) >= {least}) n ON c.chr = n.chr AND c.k = n.k
JOIN (SELECT chr, MAX("end") AS size FROM sites GROUP BY chr) z ON z.chr = c.chr GROUP BY c.sample_id, c.chr, c.k, n.n_cpgs, z.size"""


def _tiles(spark, sf, *how):
    t = intervals.tile_counts(testdata.cohort(spark, sf), *how)
    return t.calls.join(t.sites, KEY).select("sample_id", *KEY, "n_cpgs", "methylated", "coverage", *r6("beta"))


@query(_tile_sql(1000, 1000, 1))
def tile_1000(spark, sf):
    return _tiles(spark, sf, 1000)


@query(_tile_sql(1000, 500, 1))
def tile_sliding_1000_500(spark, sf):
    return _tiles(spark, sf, 1000, 500)


@query(_tile_sql(1000, 1000, 5))
def tile_min_cpgs(spark, sf):
    return _tiles(spark, sf, 1000, None, 5)


# --- cohort filters and summaries ----------------------------------------------------

_KEPT = f"SELECT {K}, strand, context FROM sites WHERE (chr, \"start\") IN (SELECT (chr, \"start\") FROM calls GROUP BY chr, \"start\" HAVING {{}})"


@query(_KEPT.format("COUNT(*) FILTER (WHERE coverage >= 60) >= 1"))
def filter_cov_any(spark, sf):
    return site_table(testdata.cohort(spark, sf).filter_coverage(60))


@query(_KEPT.format("COUNT(*) FILTER (WHERE coverage >= 10) >= 6"))
def filter_cov_all(spark, sf):
    return site_table(testdata.cohort(spark, sf).filter_coverage(10, require_all_samples=True))


@query(_KEPT.format("COUNT(*) FILTER (WHERE coverage >= 20) >= 1 AND MAX(coverage) <= 90"))
def filter_cov_max(spark, sf):
    return site_table(testdata.cohort(spark, sf).filter_coverage(20, 90))


@query(_KEPT.format("COUNT(*) = 6"))
def unite_all(spark, sf):
    return site_table(testdata.cohort(spark, sf).unite())


@query(_KEPT.format("COUNT(*) FILTER (WHERE grp = 'control') >= 3 AND COUNT(*) FILTER (WHERE grp = 'treated') >= 3"))
def unite_min_per_group(spark, sf):
    return site_table(testdata.cohort(spark, sf).unite(min_per_group=3, treatment_col="group"))


@query(f"SELECT {K}, strand, context FROM sites WHERE context = 'CHG'")
def subset_context(spark, sf):
    return site_table(testdata.cohort(spark, sf).subset_context("CHG"))


@query("SELECT sample_id, CAST(COUNT(*) AS BIGINT) AS n_calls FROM calls WHERE grp = 'treated' GROUP BY sample_id")
def subset_samples(spark, sf):
    m = testdata.cohort(spark, sf).where_samples(F.col("group") == "treated")
    return m.calls.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_calls"))


@query("SELECT sample_id, ROUND(SUM(coverage) * 1.0 / n, 6) AS mean_cov, MEDIAN(coverage) AS median_cov, n AS n_sites, COUNT(*) AS n_sites_covered, ROUND(COUNT(*) * 100.0 / n, 6) AS pct_sites_covered FROM calls, (SELECT COUNT(*) AS n FROM sites) GROUP BY sample_id, n")
def coverage_stats(spark, sf):
    return testdata.cohort(spark, sf).coverage_stats().select("sample_id", *r6("mean_cov"), "median_cov", "n_sites", "n_sites_covered", *r6("pct_sites_covered"))


@query("SELECT sample_id, ROUND(AVG(beta), 6) AS global_beta_mean, ROUND(MEDIAN(beta), 6) AS global_beta_median, CAST(SUM(methylated) AS BIGINT) AS total_methylated, CAST(SUM(coverage) AS BIGINT) AS total_coverage, ROUND(SUM(methylated) * 100.0 / SUM(coverage), 6) AS global_pct_meth FROM calls GROUP BY sample_id")
def global_methylation(spark, sf):
    return testdata.cohort(spark, sf).global_methylation().select("sample_id", *r6("global_beta_mean", "global_beta_median"), "total_methylated", "total_coverage", *r6("global_pct_meth"))


# --- statistics ------------------------------------------------------------------------

_POOLED = """, pooled AS (SELECT chr, "start", "end", CAST(COALESCE(SUM(methylated) FILTER (WHERE grp = 'control'), 0) AS BIGINT) AS t11, CAST(COALESCE(SUM(coverage - methylated) FILTER (WHERE grp = 'control'), 0) AS BIGINT) AS t12,
CAST(COALESCE(SUM(methylated) FILTER (WHERE grp = 'treated'), 0) AS BIGINT) AS t21, CAST(COALESCE(SUM(coverage - methylated) FILTER (WHERE grp = 'treated'), 0) AS BIGINT) AS t22,
AVG(beta) FILTER (WHERE grp = 'control') AS ma, AVG(beta) FILTER (WHERE grp = 'treated') AS mb FROM calls GROUP BY chr, "start", "end"),
margins AS (SELECT *, t11 + t21 AS k, t11 + t12 AS d, t11 + t12 + t21 + t22 AS n FROM pooled),
fisher AS (SELECT *, LEAST(1.0, 2 * list_sum(list_transform(range(t11, LEAST(k, d) + 1), lambda x: CASE WHEN d - x > n - k THEN 0 ELSE exp(lgamma(k + 1) - lgamma(x + 1) - lgamma(k - x + 1) + lgamma(n - k + 1) - lgamma(d - x + 1) - lgamma(n - k - d + x + 1) - lgamma(n + 1) + lgamma(d + 1) + lgamma(n - d + 1)) END))) AS p FROM margins),
tested AS (SELECT *, mb - ma AS diff, ROW_NUMBER() OVER (ORDER BY p) AS i, COUNT(*) OVER () AS m FROM fisher),
adjusted AS (SELECT *, LEAST(1.0, MIN(p * m / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS q FROM tested)
"""
_PROB = "exp(lgamma(k + 1) - lgamma({0} + 1) - lgamma(k - {0} + 1) + lgamma(n - k + 1) - lgamma(d - {0} + 1) - lgamma(n - k - d + {0} + 1) - lgamma(n + 1) + lgamma(d + 1) + lgamma(n - d + 1))"
_EXACT = _POOLED + f""", probs AS (SELECT *, list_transform(range(GREATEST(0, d + k - n), LEAST(k, d) + 1), lambda x: {_PROB.format("x")}) AS ps, {_PROB.format("t11")} AS po FROM margins),
exact AS (SELECT *, mb - ma AS diff, LEAST(1.0, list_sum(list_filter(ps, lambda v: v <= po * (1 + 1e-7)))) AS p FROM probs)
"""


@query(_POOLED + f"SELECT {K}, ROUND(ma, 6) AS mean_meth_control, ROUND(mb, 6) AS mean_meth_treated, ROUND(mb - ma, 6) AS mean_diff FROM pooled")
def group_means_diff(spark, sf):
    return stats.group_means(testdata.cohort(spark, sf), "group", "control", "treated").select(*KEY, *r6("mean_meth_control", "mean_meth_treated", "mean_diff"))


@query(_POOLED + f"SELECT {K}, t11, t12, t21, t22 FROM pooled")
def pooled_counts(spark, sf):
    return stats.pooled(testdata.cohort(spark, sf), "group", "control", "treated")


@query(_POOLED + f"SELECT {K}, ROUND(p, 6) AS pvalue, ROUND(log2(CASE WHEN t12 * t21 > 0 THEN t11 * t22 * 1.0 / (t12 * t21) WHEN t11 * t22 > 0 THEN CAST('inf' AS DOUBLE) ELSE 1 END + 1e-10), 6) AS log2_odds_ratio FROM fisher")
def fisher_dmc(spark, sf):
    return stats.fisher_exact_test(testdata.cohort(spark, sf), "group", "control", "treated").select(*KEY, *r6("pvalue", "log2_odds_ratio"))


@query(_EXACT + f"SELECT {K}, ROUND(p, 6) AS pvalue FROM exact")
def fisher_exact_two_sided(spark, sf):
    return stats.fisher_exact_test(testdata.cohort(spark, sf), "group", "control", "treated", "exact").select(*KEY, *r6("pvalue"))


_FITS = """, v AS (SELECT *, log2((methylated + 0.5) / (coverage - methylated + 0.5)) AS m FROM calls WHERE coverage > 0),
f AS (SELECT chr, "start", "end", COUNT(*) FILTER (WHERE grp = 'control') AS n0, COUNT(*) FILTER (WHERE grp = 'treated') AS n1, AVG(m) FILTER (WHERE grp = 'control') AS m0, AVG(m) FILTER (WHERE grp = 'treated') AS m1,
VAR_POP(m) FILTER (WHERE grp = 'control') AS v0, VAR_POP(m) FILTER (WHERE grp = 'treated') AS v1 FROM v GROUP BY chr, "start", "end"),
g AS (SELECT *, n0 > 0 AND n1 > 0 AND n0 + n1 > 2 AS ok FROM f),
fits AS (SELECT chr, "start", "end", CASE WHEN ok THEN m1 - m0 END AS coef, CASE WHEN ok THEN (n0 * v0 + n1 * v1) / (n0 + n1 - 2) END AS s2, CASE WHEN ok THEN n0 + n1 - 2 END AS df, CASE WHEN ok THEN sqrt(1.0 / n0 + 1.0 / n1) END AS unscaled FROM g)
"""


def _trigamma(x: str) -> str:
    y = f"({x} + 20.0)"
    return f"(list_sum(list_transform(range(20), lambda k: 1.0 / (({x} + k) * ({x} + k)))) + 1 / {y} + 1 / (2 * {y} ** 2) + 1 / (6 * {y} ** 3) - 1 / (30 * {y} ** 5) + 1 / (42 * {y} ** 7))"


def _digamma(x: str) -> str:
    y = f"({x} + 20.0)"
    return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6) - list_sum(list_transform(range(20), lambda k: 1.0 / ({x} + k))))"


def _beta_tail(x: str, y: str, a: str, b: str) -> str:
    """x^a y^b / (a B(a, b)) * 2F1(a + b, 1; a + 1; x), y being 1 - x: the incomplete beta function for x up to about 0.9."""
    return f"""(pow({x}, {a}) * pow({y}, {b}) * exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) / {a} * list_sum(list_transform(range(500), lambda n: exp(lgamma({a} + {b} + n) - lgamma({a} + {b}) - lgamma({a} + 1 + n) + lgamma({a} + 1)) * pow({x}, n))))"""


_RESULT = """numbered AS (SELECT *, ROW_NUMBER() OVER (ORDER BY p) AS i, COUNT(*) OVER () AS n FROM $from),
fdr AS (SELECT *, LEAST(1.0, MIN(p * n / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS q FROM numbered)
SELECT s.chr, s."start", s."end", s.strand, s.context, ROUND(p, 6) AS pvalue, ROUND(q, 6) AS qvalue, ROUND(mb - ma, 6) AS mean_diff, ROUND(ma, 6) AS mean_meth_control, ROUND(mb, 6) AS mean_meth_treated
FROM sites s JOIN fdr ON fdr.chr = s.chr AND fdr."start" = s."start" JOIN pooled ON pooled.chr = s.chr AND pooled."start" = s."start" """


def _limma_sql(prior: str, fits: str = _FITS) -> str:
    """prior: the rows moments (excess, and s0 as an expression of d0) of the variance prior."""
    return (CTE + _POOLED + fits + prior + f""",
root AS (SELECT 0 AS i, -40.0::DOUBLE AS lo, 40.0::DOUBLE AS hi UNION ALL
  SELECT i + 1, CASE WHEN {_trigamma("exp((lo + hi) / 2)")} > excess THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_trigamma("exp((lo + hi) / 2)")} > excess THEN hi ELSE (lo + hi) / 2 END FROM root, moments WHERE i < 100),
solved AS (SELECT moments.*, 2 * exp((lo + hi) / 2) AS d FROM moments, root WHERE i = 100),
prior AS (SELECT *, {{s0}} AS s0 FROM (SELECT *, {{d0}} AS d0 FROM solved)),
tt AS (SELECT fits.*, df + d0 AS k, pow(coef / (sqrt((df * s2 + d0 * s0) / (df + d0)) * unscaled), 2) AS t2 FROM fits, prior),
xx AS (SELECT *, k / 2 AS a, k / (k + t2) AS x, t2 / (k + t2) AS y FROM tt),
moderated AS (SELECT *, CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1.0 WHEN x > 0.1 THEN 1 - {_beta_tail("y", "x", "0.5", "a")} ELSE {_beta_tail("x", "y", "a", "0.5")} END AS p FROM xx),
""" + _RESULT.replace("$from", "moderated")).replace("WITH raw", "WITH RECURSIVE raw", 1)


_Z = "ln(GREATEST(s2, 1e-10))"
_MOMENTS = f""", moments AS (SELECT AVG({_Z}) AS mean, VAR_POP({_Z}) AS spread, AVG(df) AS d_mean, MEDIAN(s2) AS mid, VAR_POP({_Z}) - {_trigamma("(AVG(df) / 2)")} AS excess FROM fits WHERE s2 IS NOT NULL)"""


def _compat(sql: str) -> str:
    sql = sql.replace("{d0}", "CASE WHEN spread = 0 THEN 1e6 WHEN excess > 0 AND d BETWEEN 2 AND 200 THEN d ELSE 50.0 END")
    return sql.replace("{s0}", f"CASE WHEN spread = 0 THEN exp(mean) WHEN excess > 0 THEN exp(mean + {_digamma('(d_mean / 2)')} - {_digamma('(d0 / 2)')}) ELSE mid END")


_COMPAT = _compat(_limma_sql(_MOMENTS))
# with the batch as a covariate: deviations from the batch's mean make a regression without it
_BATCH = """, v AS (SELECT *, log2((methylated + 0.5) / (coverage - methylated + 0.5)) AS m, CASE WHEN grp = 'treated' THEN 1.0 ELSE 0.0 END AS t, sample_id IN ('s0', 's1', 's2') AS batch FROM calls WHERE coverage > 0),
w AS (SELECT *, m - AVG(m) OVER (PARTITION BY chr, "start", batch) AS dm, t - AVG(t) OVER (PARTITION BY chr, "start", batch) AS dt FROM v),
f AS (SELECT chr, "start", "end", COUNT(*) AS n, COUNT(DISTINCT batch) AS batches, SUM(dt * dt) AS xx, SUM(dt * dm) AS xy FROM w GROUP BY chr, "start", "end"),
g AS (SELECT *, batches = 2 AND n > 3 AND xx > 1e-9 AS ok FROM f),
rest AS (SELECT chr, "start", SUM(pow(dm - xy / xx * dt, 2)) AS rss FROM w JOIN g USING (chr, "start") WHERE ok GROUP BY chr, "start"),
fits AS (SELECT g.chr, g."start", "end", CASE WHEN ok THEN xy / xx END AS coef, CASE WHEN ok THEN rss / (n - 3) END AS s2, CASE WHEN ok THEN n - 3 END AS df, CASE WHEN ok THEN 1 / sqrt(xx) END AS unscaled FROM g LEFT JOIN rest ON rest.chr = g.chr AND rest."start" = g."start")
"""
_E = f"({_Z} - {_digamma('(df / 2)')} + ln(df / 2))"
_TEXTBOOK = _limma_sql(f""", moments AS (SELECT AVG(e) AS mean, VAR_SAMP(e) - AVG(t) AS excess FROM (SELECT {_E} AS e, {_trigamma("(df / 2)")} AS t FROM fits WHERE s2 IS NOT NULL))""")
_TEXTBOOK = _TEXTBOOK.replace("{d0}", "d").replace("{s0}", f"exp(mean + {_digamma('(d0 / 2)')} - ln(d0 / 2))")


@query(_FITS + f"SELECT {K}, ROUND(coef, 6) AS coef, ROUND(s2, 6) AS s2, df, ROUND(unscaled, 6) AS unscaled FROM fits")
def limma_stats(spark, sf):
    return stats.limma_stats(testdata.cohort(spark, sf), "group", "control", "treated").select(*KEY, *r6("coef", "s2"), "df", *r6("unscaled"))


def _tested(dmc: DataFrame) -> DataFrame:
    return dmc.select(*KEY, "strand", "context", *r6("pvalue", "qvalue", "mean_diff", "mean_meth_control", "mean_meth_treated"))


@query(_COMPAT, bare=True)
def limma_dmc(spark, sf):
    return _tested(stats.calculate_diff_meth(testdata.cohort(spark, sf), test="limma"))


@query(_COMPAT, bare=True)
def auto_dmc(spark, sf):
    return _tested(stats.calculate_diff_meth(testdata.cohort(spark, sf)))


@query(_TEXTBOOK, bare=True)
def limma_exact_prior(spark, sf):
    return _tested(stats.calculate_diff_meth(testdata.cohort(spark, sf), test="limma", method="exact"))


@query(_compat(_limma_sql(_MOMENTS, _BATCH)), bare=True)
def limma_covariates(spark, sf):
    return _tested(stats.calculate_diff_meth(testdata.cohort(spark, sf), test="limma", covariates=["batch"]))


def _pair_sum(g: str, body: str) -> str:
    """Sum over a group's samples of body in y and n."""
    return f"list_sum(list_transform(list_zip(y{g}, n{g}), lambda v: {body.replace('$y', 'v[1]').replace('$n', 'v[2]')}))"


def _mu(eta: str) -> str:
    return f"LEAST(GREATEST(1 / (1 + exp(-LEAST(GREATEST({eta}, -700.0), 700.0))), 1e-8), 1 - 1e-8)"


def _weight(mu: str) -> str:
    return f"GREATEST($n * {mu} * (1 - {mu}), 1e-10)"


def _deviance(g: str, mu: str) -> str:
    y, m = "LEAST(GREATEST($y, 1e-10), 1 - 1e-10)", f"LEAST(GREATEST({mu}, 1e-10), 1 - 1e-10)"
    return f"2 * {_pair_sum(g, f'({y} * ln({y} / {m}) + (1 - {y}) * ln((1 - {y}) / (1 - {m})))')}"


def _erfc(x: str) -> str:
    """By the series of erf with positive terms; 0 to six places beyond 6."""
    return f"CASE WHEN {x} > 6 THEN 0.0 ELSE GREATEST(0.0, 1 - 1.1283791670955126 * exp(-({x}) * ({x})) * {x} * list_sum(list_transform(range(200), lambda n: exp(n * ln(2 * ({x}) * ({x}) + 1e-300) - (lgamma(2 * n + 2) - n * ln(2) - lgamma(n + 1)))))) END"


_GLM = CTE.replace("WITH raw", "WITH RECURSIVE raw", 1) + f""", wide AS (SELECT chr, "start", "end", {', '.join(f"MAX(CASE WHEN sample_id = 's{i}' THEN methylated * 1.0 / coverage END) AS y{i}, MAX(CASE WHEN sample_id = 's{i}' THEN coverage END) AS n{i}" for i in range(6))} FROM calls WHERE coverage > 0 GROUP BY chr, "start", "end"),
site AS (SELECT chr, "start", "end", {', '.join(f"[{', '.join(f'COALESCE({c}{i}, 0.0)::DOUBLE' for i in own)}] AS {c}{g}" for g, own in (('a', (0, 2, 4)), ('b', (1, 3, 5))) for c in 'yn')} FROM wide),
it AS (SELECT *, 0 AS k, 0.0::DOUBLE AS c0, 0.0::DOUBLE AS c1, 0.0::DOUBLE AS la, 0.0::DOUBLE AS lb, 1.0::DOUBLE AS moved FROM site UNION ALL
  SELECT chr, "start", "end", ya, na, yb, nb, k + 1, d0, d1, c0, c0 + c1, GREATEST(abs(d0 - c0), abs(d1 - c1)) FROM
  (SELECT *, (ta * sb + 1e-12 * (ta + tb)) / det AS d0, (sa * tb - sb * ta + 1e-12 * tb) / det AS d1 FROM
  (SELECT *, c0 * sa + ra AS ta, (c0 + c1) * sb + rb AS tb, sa * sb + 1e-12 * (sa + 2 * sb) + 1e-24 AS det FROM
  (SELECT *, {_pair_sum("a", _weight("mu_a"))} AS sa, {_pair_sum("b", _weight("mu_b"))} AS sb, {_pair_sum("a", "($y - mu_a)")} AS ra, {_pair_sum("b", "($y - mu_b)")} AS rb FROM
  (SELECT *, {_mu("c0")} AS mu_a, {_mu("c0 + c1")} AS mu_b FROM it WHERE k < 30 AND moved >= 1e-6))))),
fitted AS (SELECT *, {_mu("c0")} AS mu_a, {_mu("c0 + c1")} AS mu_b, {_mu("la")} AS v_a, {_mu("lb")} AS v_b FROM it QUALIFY ROW_NUMBER() OVER (PARTITION BY chr, "start" ORDER BY k DESC) = 1),
"""
_WALD = _GLM + f"""parts AS (SELECT *, {_pair_sum("a", _weight("v_a"))} AS sa, {_pair_sum("b", _weight("v_b"))} AS sb, {_pair_sum("a", f"(($y - mu_a) * ($y - mu_a) / {_weight('v_a')})")} AS ca, {_pair_sum("b", f"(($y - mu_b) * ($y - mu_b) / {_weight('v_b')})")} AS cb FROM fitted),
z AS (SELECT *, abs(c1 / GREATEST(sqrt(ca / (sa * sa) + cb / (sb * sb)), 1e-10)) / sqrt(2) AS x FROM parts),
wald AS (SELECT {K}, CASE WHEN list_sum(na) = 0 OR list_sum(nb) = 0 THEN 1.0 ELSE {_erfc("x")} END AS p FROM z)
"""
_LRT = _GLM + f"""alone AS (SELECT *, 0 AS k, 0.0::DOUBLE AS c0, 1.0::DOUBLE AS moved FROM site UNION ALL
  SELECT chr, "start", "end", ya, na, yb, nb, k + 1, d0, abs(d0 - c0) FROM
  (SELECT *, (c0 * s + r) / (s + 1e-12) AS d0 FROM
  (SELECT *, {_pair_sum("a", _weight("mu"))} + {_pair_sum("b", _weight("mu"))} AS s, {_pair_sum("a", "($y - mu)")} + {_pair_sum("b", "($y - mu)")} AS r FROM
  (SELECT *, {_mu("c0")} AS mu FROM alone WHERE k < 30 AND moved >= 1e-6)))),
without AS (SELECT *, {_mu("c0")} AS mu FROM alone QUALIFY ROW_NUMBER() OVER (PARTITION BY chr, "start" ORDER BY k DESC) = 1),
d1 AS (SELECT {K}, {_deviance("a", "mu_a")} + {_deviance("b", "mu_b")} AS full_dev FROM fitted),
d0 AS (SELECT {K}, {_deviance("a", "mu")} + {_deviance("b", "mu")} AS null_dev FROM without),
lr AS (SELECT {K}, CASE WHEN list_sum(na) = 0 OR list_sum(nb) = 0 THEN 0.0 ELSE GREATEST(null_dev - full_dev, 0.0) END AS stat FROM d0 JOIN d1 USING ({K}) JOIN site USING ({K})),
z AS (SELECT *, sqrt(stat / 2) AS x FROM lr)
SELECT {K}, ROUND(stat, 6) AS statistic, ROUND({_erfc("x")}, 6) AS pvalue FROM z"""


@query(_WALD + f"SELECT {K}, ROUND(p, 6) AS pvalue FROM wald", bare=True)
def glm_wald(spark, sf):
    return stats.glm_lrt_test(testdata.cohort(spark, sf), "group", "control", "treated").select(*KEY, *r6("pvalue"))


@query(_LRT, bare=True)
def glm_lrt(spark, sf):
    return stats.glm_lrt_test(testdata.cohort(spark, sf), "group", "control", "treated", overdispersion=False).select(*KEY, *r6("statistic", "pvalue"))


@query(_WALD + _POOLED + ", " + _RESULT.replace("$from", "wald"), bare=True)
def glm_dmc(spark, sf):
    return _tested(stats.calculate_diff_meth(testdata.cohort(spark, sf), test="glm"))


@query()
def glm_exact(spark, sf):
    return stats.glm_lrt_test(testdata.cohort(spark, sf), "group", "control", "treated", overdispersion=False, covariates=["batch"], method="exact")


def _pvalues(spark, sf):
    c = testdata.calls(spark, sf)
    p = (((F.col("methylated") * 7919 + F.col("coverage") * 104729 + F.col("start")) % 10007) + 1) / F.lit(10008.0)
    return c.select("sample_id", *KEY, p.alias("pvalue"))


_P = """, pv AS (SELECT sample_id, chr, "start", "end", (((methylated * 7919 + coverage * 104729 + "start") % 10007) + 1) / 10008.0 AS p FROM calls),
o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY p) AS i, COUNT(*) OVER () AS n FROM pv),
u AS (SELECT *, MAX(i) OVER (PARTITION BY p) AS hi, MIN(i) OVER (PARTITION BY p) AS lo FROM o)
SELECT sample_id, chr, "start", "end", ROUND(p, 6) AS pvalue, ROUND({}, 6) AS qvalue FROM u"""


def _fdr(spark, sf, method):
    return stats.fdr(_pvalues(spark, sf), method).select("sample_id", *KEY, *r6("pvalue", "qvalue"))


@query(_P.format("LEAST(1.0, MIN(p * n / hi) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING))"))
def fdr_bh(spark, sf):
    return _fdr(spark, sf, "BH")


@query(_P.format("LEAST(1.0, p * n)"))
def fdr_bonferroni(spark, sf):
    return _fdr(spark, sf, "bonferroni")


@query(_P.format("LEAST(1.0, MAX(p * (n - lo + 1)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING))"))
def fdr_holm(spark, sf):
    return _fdr(spark, sf, "holm")


@query(_P.format("LEAST(1.0, MIN(p * n / hi) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING) * (SELECT SUM(1.0 / j) FROM range(1, (SELECT COUNT(*) FROM calls) + 1) r(j)))"))
def fdr_by(spark, sf):
    return _fdr(spark, sf, "fdr_by")


# --- regions -----------------------------------------------------------------------------

_DMR = """, sig AS (SELECT *, LAG("end") OVER w AS prev_end, LAG(sign(diff)) OVER w AS prev_sign, ROW_NUMBER() OVER w AS rn FROM ({}) WHERE q < {} AND diff IS NOT NULL WINDOW w AS (PARTITION BY chr ORDER BY "start", "end")),
isl AS (SELECT *, SUM(CASE WHEN prev_end IS NULL OR "start" - prev_end > {} OR sign(diff) <> prev_sign THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY rn) AS island FROM sig),
reg AS (SELECT chr, MIN("start") AS "start", MAX_BY("end", rn) AS "end", COUNT(*) AS n_cpgs, AVG(diff) AS mean_diff, MIN(q) AS min_qvalue FROM isl GROUP BY chr, island),
dmrs AS (SELECT *, CASE WHEN mean_diff > 0 THEN 'hyper' ELSE 'hypo' END AS direction FROM reg WHERE n_cpgs >= {} AND abs(mean_diff) >= {})
"""
_DIFFS = "SELECT chr, \"start\", \"end\", mb - ma AS diff, 1.0 - LEAST(1.0, abs(mb - ma) / 100.0) AS q FROM pooled WHERE ma IS NOT NULL AND mb IS NOT NULL"


def _diffs(spark, sf):
    d = stats.group_means(testdata.cohort(spark, sf), "group", "control", "treated").where("mean_diff is not null")
    return d.withColumn("qvalue", 1.0 - F.least(F.lit(1.0), F.abs("mean_diff") / 100.0))


_CUT = _POOLED + _DMR.format(_DIFFS, 0.85, 2000, 2, 10)


def _dmrs(spark, sf):
    return dmr.merge_dmrs(_diffs(spark, sf), qvalue_cutoff=0.85, max_gap=2000, min_sites=2)


@query(_CUT + 'SELECT chr, "start", "end", n_cpgs, ROUND(mean_diff, 6) AS mean_diff, ROUND(min_qvalue, 6) AS min_qvalue, direction FROM dmrs')
def merge_dmrs(spark, sf):
    return _dmrs(spark, sf).select(*KEY, "n_cpgs", *r6("mean_diff", "min_qvalue"), "direction")


@query(_CUT + "SELECT chr, \"start\", \"end\", n_cpgs, direction FROM dmrs WHERE direction = 'hyper' AND n_cpgs >= 3 AND abs(mean_diff) >= 20 AND min_qvalue <= 0.7 AND chr IN ('chr1', 'chr2', 'chr3', 'chr5', 'chr8')")
def filter_dmrs(spark, sf):
    return dmr.filter_dmrs(_dmrs(spark, sf), direction="hyper", min_n_cpgs=3, min_abs_diff=20, max_qvalue=0.7, chromosomes=["chr1", "chr2", "chr3", "chr5", "chr8"]).select(*KEY, "n_cpgs", "direction")


@query(_CUT + "SELECT chr, \"start\", \"end\", direction AS name, CAST(floor(LEAST(abs(mean_diff) * 10, 1000)) AS INT) AS score, '.' AS strand FROM dmrs")
def dmrs_bed(spark, sf):
    return sinks.dmr_bed(_dmrs(spark, sf))


@query(_CUT + 'SELECT chr, "start", "end", n_cpgs, ROUND(mean_diff, 6) AS mean_diff, direction FROM dmrs')
def result_table_file(spark, sf):
    path = scratch.folder(spark, "dmrs")
    sinks.write_tsv(_dmrs(spark, sf), path)
    return readers.read_table(spark, path).select(*KEY, F.col("n_cpgs").cast("long").alias("n_cpgs"), *r6("mean_diff"), "direction")


@query(_CUT + "SELECT chr, \"start\", \"end\", direction AS column_4, CAST(CAST(floor(LEAST(abs(mean_diff) * 10, 1000)) AS INT) AS VARCHAR) AS column_5, '.' AS column_6 FROM dmrs")
def dmrs_bed_file(spark, sf):
    path = scratch.folder(spark, "dmrs")
    sinks.dmrs_to_bed(_dmrs(spark, sf), path)
    return readers.read_bed(spark, path).drop("bed_row")


@query(_POOLED + f"SELECT {K}, ROUND(mb - ma, 6) AS mean_diff FROM pooled WHERE mb - ma IS NOT NULL ORDER BY mb - ma DESC, {K} LIMIT 50")
def top_hyper_k(spark, sf):
    return dmr.top(_diffs(spark, sf), 50).select(*KEY, *r6("mean_diff"))


@query(_POOLED + f"SELECT {K}, ROUND(mb - ma, 6) AS mean_diff FROM pooled WHERE mb - ma IS NOT NULL ORDER BY mb - ma, {K} LIMIT 50")
def top_hypo_k(spark, sf):
    return dmr.top(_diffs(spark, sf), 50, hyper=False).select(*KEY, *r6("mean_diff"))


_ANY = _POOLED + _DMR.format(_DIFFS, 0.85, 2000, 1, 0).replace(" OR sign(diff) <> prev_sign", "").replace("q < 0.85 AND", "q < 0.85 AND abs(diff) >= 15 AND")


@query(_ANY + 'SELECT chr, "start", "end", n_cpgs, ROUND(mean_diff, 6) AS mean_diff, ROUND(min_qvalue, 6) AS min_qvalue, direction FROM dmrs')
def merge_dmrs_any_direction(spark, sf):
    out = dmr.merge_dmrs(_diffs(spark, sf), qvalue_cutoff=0.85, mean_diff_cutoff=15, max_gap=2000, min_sites=1, min_abs_diff=0, same_direction=False)
    return out.select(*KEY, "n_cpgs", *r6("mean_diff", "min_qvalue"), "direction")


_FLAG = _EXACT + """, ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY p) AS i, COUNT(*) OVER () AS m FROM exact),
corrected AS (SELECT *, LEAST(1.0, MIN(p * m / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS q FROM ranked)
""" + _DMR.format("SELECT * FROM corrected", 0.05, 1000, 1, 10)


@query(_FLAG + 'SELECT chr, "start", "end", n_cpgs, ROUND(mean_diff, 6) AS mean_diff, ROUND(min_qvalue, 6) AS min_qvalue, direction FROM dmrs')
def flagship_fisher_dmr(spark, sf):
    return flagship(spark, sf)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort -> pooled exact tests -> FDR -> merged regions."""
    m = testdata.cohort(spark, sf_dir)
    dmc = stats.calculate_diff_meth(m, test="fisher", method="exact", sort=False)
    return dmr.merge_dmrs(dmc, min_sites=1).select(*KEY, "n_cpgs", *r6("mean_diff", "min_qvalue"), "direction")


@query(_FLAG + "SELECT COUNT(*) AS n_tested, COUNT(*) FILTER (WHERE q < 0.05) AS n_significant, COUNT(*) FILTER (WHERE q < 0.05 AND diff > 0) AS n_hyper, COUNT(*) FILTER (WHERE q < 0.05 AND diff < 0) AS n_hypo FROM corrected")
def significance_counts(spark, sf):
    return stats.significance(stats.calculate_diff_meth(testdata.cohort(spark, sf), test="fisher", method="exact"))


# --- quality control -----------------------------------------------------------------------


@query(""", d AS (SELECT c.sample_id, c.chr, c."start", beta - m.mu AS v FROM calls c JOIN (SELECT sample_id, AVG(beta) AS mu FROM calls GROUP BY sample_id) m ON c.sample_id = m.sample_id),
g AS (SELECT a.sample_id AS i, b.sample_id AS j, SUM(a.v * b.v) AS g FROM d a JOIN d b ON a.chr = b.chr AND a."start" = b."start" AND a.sample_id <= b.sample_id GROUP BY a.sample_id, b.sample_id)
SELECT g.i, g.j, ROUND(g.g / sqrt(x.g) / sqrt(y.g), 6) AS corr FROM g JOIN g x ON x.i = g.i AND x.j = g.i JOIN g y ON y.i = g.j AND y.j = g.j""")
def pearson_corr(spark, sf):
    return qc.correlation_pairs(testdata.cohort(spark, sf)).select("i", "j", *r6("corr"))


@query(""", m AS (SELECT sample_id, AVG(beta) AS mu FROM calls GROUP BY sample_id),
f AS (SELECT m.sample_id, t.chr, t."start", COALESCE(c.beta, m.mu) AS b FROM sites t CROSS JOIN m LEFT JOIN calls c ON c.sample_id = m.sample_id AND c.chr = t.chr AND c."start" = t."start"),
r AS (SELECT *, RANK() OVER (PARTITION BY sample_id ORDER BY b) + (COUNT(*) OVER (PARTITION BY sample_id, b) - 1) / 2.0 AS r FROM f)
SELECT a.sample_id AS i, b.sample_id AS j, ROUND(corr(a.r, b.r), 6) AS corr FROM r a JOIN r b ON a.chr = b.chr AND a."start" = b."start" AND a.sample_id <= b.sample_id GROUP BY a.sample_id, b.sample_id""")
def spearman_corr(spark, sf):
    return qc.correlation_pairs(testdata.cohort(spark, sf), "spearman").select("i", "j", *r6("corr"))


@query(""", d AS (SELECT sample_id, chr, "start", beta - AVG(beta) OVER (PARTITION BY chr, "start") AS v FROM calls)
SELECT a.sample_id AS i, b.sample_id AS j, ROUND(SUM(a.v * b.v), 3) AS g FROM d a JOIN d b ON a.chr = b.chr AND a."start" = b."start" AND a.sample_id <= b.sample_id GROUP BY a.sample_id, b.sample_id""")
def pca_gram(spark, sf):
    return qc.pca_gram(testdata.cohort(spark, sf)).select("i", "j", F.round("g", 3).alias("g"))


@query()
def pca_scores(spark, sf):
    scores, share = qc.pca(testdata.cohort(spark, sf), 5)
    return spark.createDataFrame(scores.reset_index(names="sample_id"))


@query()
def assoc_components(spark, sf):
    return spark.createDataFrame(qc.assoc_comp(testdata.cohort(spark, sf), 3).reset_index(names="component"))


@query()
def umap_layout(spark, sf):
    return spark.createDataFrame(qc.umap(testdata.cohort(spark, sf)).reset_index(names="sample_id"))


@query(""", c AS (SELECT sample_id, CAST(LEAST(coverage, 200) AS DOUBLE) AS c, coverage FROM calls), e AS (SELECT sample_id, MIN(c) AS lo, MAX(c) AS hi, AVG(coverage) AS mean_cov FROM c GROUP BY sample_id)
SELECT c.sample_id, CAST(LEAST(floor((c - lo) * 100 / (hi - lo)), 99) AS INT) AS bin, COUNT(*) AS n, ROUND(mean_cov, 6) AS mean_cov FROM c JOIN e ON c.sample_id = e.sample_id GROUP BY c.sample_id, 2, mean_cov""")
def coverage_hist(spark, sf):
    return qc.coverage_hist(testdata.cohort(spark, sf)).select("sample_id", "bin", "n", *r6("mean_cov"))


@query("SELECT sample_id, CAST(LEAST(floor(beta * 50 / 100.0), 49) AS INT) AS bin, COUNT(*) AS n, ROUND(COUNT(*) * 0.5 / SUM(COUNT(*)) OVER (PARTITION BY sample_id), 6) AS density FROM calls GROUP BY sample_id, 2")
def beta_hist(spark, sf):
    return qc.methylation_distribution(testdata.cohort(spark, sf), "hist").select("sample_id", "bin", "n", *r6("density"))


@query("SELECT sample_id, COUNT(*) AS n, ROUND(AVG(beta), 6) AS mean, ROUND(MIN(beta), 6) AS q0, ROUND(quantile_cont(beta, 0.25), 6) AS q25, ROUND(MEDIAN(beta), 6) AS q50, ROUND(quantile_cont(beta, 0.75), 6) AS q75, ROUND(MAX(beta), 6) AS q100 FROM calls GROUP BY sample_id")
def beta_quantiles(spark, sf):
    return qc.methylation_distribution(testdata.cohort(spark, sf), "box").select("sample_id", "n", *r6("mean", "q0", "q25", "q50", "q75", "q100"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
