import math
from fractions import Fraction
from math import comb

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from methylake.functions import special
from methylake.operators import dmr, intervals, qc, stats

SITES = [("chr1", 1000, 1001), ("chr1", 2000, 2001), ("chr1", 3000, 3001), ("chr2", 500, 501)]


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame(SITES, "chr string, start bigint, end bigint")


def test_filters(toy):
    assert toy.filter_coverage(0).n_sites == 10
    assert toy.filter_coverage(1000).n_sites == 0
    assert toy.filter_coverage(0, 5).n_sites == 0
    assert toy.filter_coverage(30, require_all_samples=True).n_sites <= toy.filter_coverage(30).n_sites
    assert toy.subset_context("CpG").n_sites == 10
    assert toy.subset_context("CHG").n_sites == 0
    with pytest.raises(ValueError):
        toy.subset_context("INVALID")
    assert toy.unite().n_sites == 10
    with pytest.raises(ValueError):
        toy.unite(min_per_group=1)
    holed = type(toy)(toy.calls.where("not (sample_id = 'ctrl_1' and start = 1000)"), toy.sites, toy.samples)
    assert holed.unite().n_sites == 9
    assert holed.unite("union").n_sites == 10
    assert holed.unite(min_per_group=1, treatment_col="group").n_sites == 10
    assert len(toy) == 4 and "4 samples" in repr(toy)
    with pytest.raises(ValueError):
        type(toy)(toy.calls.drop("coverage"), toy.sites, toy.samples)


def test_merge(spark):
    def run(*r):
        return sorted((x.start, x.end) for x in intervals.merge(spark.createDataFrame([("c", *p) for p in r], "chr string, start long, end long")).collect())

    assert run((0, 10), (10, 20)) == [(0, 20)]
    assert run((0, 10), (11, 20)) == [(0, 10), (11, 20)]
    assert run((0, 100), (10, 20), (90, 120)) == [(0, 120)]
    with pytest.raises(ValueError):
        intervals.validate(spark.createDataFrame([("c", 5, 4)], "chr string, start long, end long"))


def test_overlaps_brute_force(spark):
    rng = np.random.default_rng(1)
    mk = lambda n, w: [("c", int(s), int(s) + int(rng.integers(1, w))) for s in rng.integers(0, 200_000, n)]
    a, b = mk(150, 5000), mk(80, 60_000)
    got = sorted((r.start, r.end, r.r_start, r.r_end) for r in intervals.overlaps(spark.createDataFrame(a, "chr string, start long, end long"), spark.createDataFrame(b, "chr string, start long, end long")).collect())
    assert got == sorted((x[1], x[2], y[1], y[2]) for x in a for y in b if x[1] < y[2] and x[2] > y[1])


@pytest.mark.parametrize(("window", "want"), [(1000, {("chr1", 1000, 2000), ("chr1", 2000, 3000), ("chr1", 3000, 3001), ("chr2", 0, 501)}), (2000, {("chr1", 0, 2000), ("chr1", 2000, 3001), ("chr2", 0, 501)}), (5000, {("chr1", 0, 3001), ("chr2", 0, 501)})])
def test_tiles(spark, sites, window, want):
    from methylake.operators.cohort import MethylFrame

    calls = sites.crossJoin(spark.createDataFrame([("a",), ("b",)], "sample_id string")).withColumns({"methylated": F.lit(2).cast("long"), "coverage": F.lit(5).cast("long")})
    m = MethylFrame(calls, sites, spark.createDataFrame([("a",), ("b",)], "sample_id string"))
    t = intervals.tile_counts(m, window)
    assert {(r.chr, r.start, r.end) for r in t.sites.collect()} == want
    assert t.calls.agg(F.sum("coverage")).first()[0] == 40  # conserved by windows that don't overlap
    assert all(r.beta == 40.0 for r in t.calls.collect())


def test_annotation(spark, sites):
    bed = spark.createDataFrame([("chr1", 900, 3500, "gene_A"), ("chr2", 400, 600, "gene_B")], "chr string, start long, end long, column_4 string")
    assert {r.feature for r in intervals.annotate_features(sites, bed).collect()} == {"chr1:900-3500", "chr2:400-600"}
    assert {r.feature for r in intervals.annotate_features(sites, bed, name_col=4).collect()} == {"gene_A", "gene_B"}
    far = spark.createDataFrame([("chrX", 999_000, 999_999)], "chr string, start long, end long")
    assert {r.feature for r in intervals.annotate_features(sites, far).collect()} == {None}
    isl = spark.createDataFrame([("chr1", 950, 3200), ("chr2", 450, 550)], "chr string, start long, end long")
    more = sites.union(spark.createDataFrame([("chr1", 11_000, 11_001), ("chr1", 4000, 4001), ("chr1", 6500, 6501)], sites.schema))
    got = {(r.chr, r.start): r.cpg_region for r in intervals.annotate_cpg_islands(more, isl).collect()}
    assert got == {("chr1", 1000): "island", ("chr1", 2000): "island", ("chr1", 3000): "island", ("chr2", 500): "island", ("chr1", 11_000): "open_sea", ("chr1", 4000): "shore", ("chr1", 6500): "shelf"}


def test_special():
    a, b, c, d = 37, 22, 23, 50
    n, k, m = a + b + c + d, a + c, a + b
    p = {x: Fraction(comb(k, x) * comb(n - k, m - x), comb(n, m)) for x in range(max(0, m - n + k), min(k, m) + 1)}
    upper, two = special.hypergeom_tails([a, 23], [b, 51], [c, 44], [d, 20])
    assert upper[0] == pytest.approx(float(sum(v for x, v in p.items() if x >= a)), rel=1e-10)
    assert two[0] == pytest.approx(float(sum(v for v in p.values() if v <= p[a])), rel=1e-10)
    assert two[1] == pytest.approx(1.5926e-05, rel=1e-3)
    assert special.norm_sf2(np.array([1.959963984540054]))[0] == pytest.approx(0.05)
    assert special.chi2_sf(np.array([3.841458820694124]))[0] == pytest.approx(0.05)
    assert special.chi2_sf(np.array([5.991464547107979]), 2)[0] == pytest.approx(0.05)
    assert special.t_sf2(np.array([2.2281388519649385]), np.array([10.0]))[0] == pytest.approx(0.05, rel=1e-9)
    assert special.f_sf(np.array([4.102821]), 2, 10)[0] == pytest.approx(0.05, rel=1e-5)
    assert special.digamma(1) == pytest.approx(-0.5772156649015329)
    assert special.trigamma(1) == pytest.approx(math.pi**2 / 6)


def test_fisher_modes(spark):
    from methylake.operators.cohort import MethylFrame

    rows = [("a", "chr1", 0, 1, 23, 74, 31.0), ("b", "chr1", 0, 1, 44, 64, 68.0)]
    calls = spark.createDataFrame(rows, "sample_id string, chr string, start long, end long, methylated long, coverage long, beta double")
    m = MethylFrame(calls, calls.select("chr", "start", "end").distinct(), spark.createDataFrame([("a", "control"), ("b", "treated")], "sample_id string, group string"))
    one = lambda method: stats.fisher_exact_test(m, "group", "control", "treated", method).first()
    assert one("compat").pvalue == 1.0
    assert one("exact").pvalue == pytest.approx(1.5926e-05, rel=1e-3)
    assert one("exact").log2_odds_ratio == pytest.approx(math.log2(23 * 20 / (51 * 44)))
    assert "log2_odds_ratio" in stats.calculate_diff_meth(m).columns  # one against one


def test_fisher_large_counts_match_sql(spark):
    import duckdb

    from methylake.operators.cohort import MethylFrame
    from methylake.plans import registry

    a, b, c, d = 6680, 10780, 2633, 4327  # the p-value is next to a half in the sixth place
    rows = [("a", "chr1", 0, 1, a, a + b, 38.0), ("b", "chr1", 0, 1, c, c + d, 37.0)]
    calls = spark.createDataFrame(rows, "sample_id string, chr string, start long, end long, methylated long, coverage long, beta double")
    m = MethylFrame(calls, calls.select("chr", "start", "end").distinct(), spark.createDataFrame([("a", "control"), ("b", "treated")], "sample_id string, group string"))
    own = f"""WITH calls AS (SELECT 'chr1' AS chr, 0 AS "start", 1 AS "end", * FROM (VALUES ('control', {a}::BIGINT, {a + b}::BIGINT, 38.0), ('treated', {c}, {c + d}, 37.0)) v(grp, methylated, coverage, beta))"""
    (want,) = duckdb.connect().execute(own + registry._POOLED + "SELECT p FROM fisher").fetchall()[0]
    p = stats.fisher_exact_test(m, "group", "control", "treated")
    assert p.first().pvalue == pytest.approx(want, rel=1e-13)
    assert p.select(F.round("pvalue", 6)).first()[0] == round(want, 6)
    # many wide tables are cut into parts, none is lost
    many = [np.full(300, x) for x in (a, b, c, d)]
    upper, two = special.hypergeom_tails(*many)
    assert len(upper) == len(two) == 300 and np.ptp(upper) == 0 and 2 * upper[0] == pytest.approx(want, rel=1e-13)
    assert [len(x) for x in special.hypergeom_tails(*(v[:0] for v in many))] == [0, 0]


def test_diff_meth(toy):
    out = stats.calculate_diff_meth(toy)
    assert "log2_odds_ratio" not in out.columns and out.count() == 10
    p = [r.pvalue for r in stats.ordered(out).collect()]
    assert p == sorted(p) and all(0 <= x <= 1 for x in p)
    with pytest.raises(ValueError):
        stats.calculate_diff_meth(toy, treatment_col="nope")
    with pytest.raises(ValueError):
        stats.calculate_diff_meth(toy, test="nope")
    with pytest.raises(ValueError):
        stats.calculate_diff_meth(toy, min_sites=11)
    turned = stats.calculate_diff_meth(toy, treatment="control", control="treatment")
    a = {(r.chr, r.start): r.mean_diff for r in out.collect()}
    assert all(r.mean_diff == pytest.approx(-a[r.chr, r.start]) for r in turned.collect())


def test_limma_forms_agree(toy):
    """The closed form equals least squares on the same design."""
    a = {(r.chr, r.start): r.pvalue for r in stats.limma_ebayes_test(toy, "group", "control", "treatment").collect()}
    b = {(r.chr, r.start): r.pvalue for r in stats.limma_ebayes_test(toy, "group", "control", "treatment", covariates=["unknown"]).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-9) for k in a)


def test_binomial_fit():
    x = np.array([[1.0, 0], [1, 0], [1, 1], [1, 1]])
    m, n = np.array([[9.0, 9, 21, 21]]), np.full((1, 4), 30.0)
    coef, w, mu, dev = stats.fit_binomial(m, n, x, "exact")
    assert coef[0] == pytest.approx([math.log(3 / 7), 2 * math.log(7 / 3)], rel=1e-6)
    assert dev[0] == pytest.approx(0, abs=1e-8)
    damped = stats.fit_binomial(m, n, x)[0]
    assert damped[0] == pytest.approx([-0.522, 1.044], abs=1e-3)  # thirty damped steps stop short of the optimum
    eta = {0: 0.0, 1: 0.0}
    for _ in range(30):  # the two groups decouple
        for g, y in ((0, 0.3), (1, 0.7)):
            u = 1 / (1 + math.exp(-eta[g]))
            eta[g] += 2 * (y - u) / (2 * 30 * u * (1 - u))
    assert damped[0, 0] == pytest.approx(eta[0], abs=1e-9) and damped[0].sum() == pytest.approx(eta[1], abs=1e-9)
    assert stats.model_se(w, x)[0, 1] == pytest.approx(math.sqrt(1 / w[0, :2].sum() + 1 / w[0, 2:].sum()))


def test_fdr(spark):
    def run(p, method="BH"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, pvalue double")
        return [r.qvalue for r in stats.fdr(df, method).orderBy("i").collect()]

    assert run([0.001, 0.01, 0.05, 0.1, 0.5, 1.0]) == pytest.approx([0.006, 0.03, 0.1, 0.15, 0.6, 1.0])
    assert run([0.001, 0.005, 0.01, 0.05, 0.3, 0.9]) == pytest.approx([0.006, 0.015, 0.02, 0.075, 0.36, 0.9])
    assert run([0.01, None, float("nan"), 0.02]) == pytest.approx([0.02, 1.0, 1.0, 0.02])
    assert run([0.03, 0.03, 0.5]) == pytest.approx([0.045, 0.045, 0.5])
    assert run([0.01, 0.04, 0.03], "holm") == pytest.approx([0.03, 0.06, 0.06])
    assert run([0.01, 0.04], "bonferroni") == pytest.approx([0.02, 0.08])
    assert run([0.01, 0.04], "fdr_by") == pytest.approx([0.03, 0.06])


DMC = [("chr1", 1000, 1001, 0.01, -25.0), ("chr1", 1050, 1051, 0.02, -22.0), ("chr1", 1100, 1101, 0.03, -28.0), ("chr1", 1150, 1151, 0.04, -30.0), ("chr1", 1200, 1201, 0.001, -20.0), ("chr1", 5000, 5001, 0.8, 5.0), ("chr2", 200, 201, 0.01, 15.0), ("chr2", 300, 301, 0.02, 18.0), ("chr2", 400, 401, 0.03, 12.0)]


def test_dmrs(spark):
    d = spark.createDataFrame(DMC, "chr string, start long, end long, qvalue double, mean_diff double")
    got = sorted((r.chr, r.start, r.end, r.n_cpgs, r.mean_diff, r.min_qvalue, r.direction) for r in dmr.merge_dmrs(d).collect())
    assert got == [("chr1", 1000, 1201, 5, -25.0, 0.001, "hypo"), ("chr2", 200, 401, 3, 15.0, 0.01, "hyper")]
    assert dmr.merge_dmrs(d, min_sites=2, min_abs_diff=0).count() == 2
    assert dmr.merge_dmrs(d, max_gap=20).count() == 0
    assert dmr.merge_dmrs(d, qvalue_cutoff=0.001).count() == 0
    assert dmr.merge_dmrs(d, min_sites=10).count() == 0
    with pytest.raises(ValueError):
        dmr.merge_dmrs(d.drop("qvalue"))


def test_qc(toy):
    scores, share = qc.pca(toy)
    assert scores.shape == (4, 3) and share.sum() == pytest.approx(1.0)
    wide = toy.calls.toPandas().pivot_table(index="sample_id", columns=["chr", "start"], values="beta")
    x = wide - wide.mean()
    s = np.linalg.svd(x.to_numpy(), compute_uv=False)
    assert np.abs(scores).max().max() <= s[0] + 1e-6 and share[0] == pytest.approx(s[0] ** 2 / (s**2).sum())
    m = qc.sample_correlation(toy)
    assert m.loc["ctrl_1", "treat_1"] == pytest.approx(np.corrcoef(wide.loc["ctrl_1"], wide.loc["treat_1"])[0, 1])
    assert set(qc.assoc_comp(toy).columns) == {"group", "batch"}
    assert qc.kruskal([np.array([1.0, 2, 3]), np.array([4.0, 5, 6])]) == pytest.approx(0.04953461, rel=1e-6)
    assert qc.umap(toy).shape == (4, 2)
    assert isinstance(scores, pd.DataFrame)
    with pytest.raises(ValueError):
        qc.methylation_distribution(toy, "pie")


def test_priors():
    from methylake.functions import special

    for y in (1e-3, 0.3, 2.0, 50.0):
        assert special.trigamma(special.trigamma_inverse(y)) == pytest.approx(y, rel=1e-9)
    never = lambda: pytest.fail("the median isn't needed")
    assert stats.ebayes_prior(0.5, 0.0, 4, never) == (1e6, math.exp(0.5))
    assert stats.ebayes_prior(0.5, float("nan"), 4, never)[0] == 1e6
    assert stats.ebayes_prior(0.5, special.trigamma(2.0) / 2, 4, lambda: 7.0) == (50.0, 7.0)
    d0, s0 = stats.ebayes_prior(0.5, special.trigamma(2.0) + special.trigamma(3.0), 4, never)
    assert d0 == pytest.approx(6, abs=1e-6) and s0 == pytest.approx(math.exp(0.5 + special.digamma(2) - special.digamma(3)))
    assert stats.ebayes_prior(0.5, special.trigamma(2.0) + special.trigamma(0.5), 4, never)[0] == 50.0  # a root out of range
    # scaled F variances: the textbook prior finds the scale and the degrees of freedom
    rng = np.random.default_rng(3)
    d = np.repeat([3.0, 5.0], 40_000)
    s2 = 2.5 * rng.chisquare(d) / d / (rng.chisquare(8, d.size) / 8)
    z = np.log(s2)
    d0, s0 = stats.exact_prior([(k, int((d == k).sum()), float(z[d == k].sum()), float((z[d == k] ** 2).sum())) for k in (3.0, 5.0)])
    assert d0 == pytest.approx(8, rel=0.1) and s0 == pytest.approx(2.5, rel=0.03)
    same = np.log(rng.chisquare(5, 50_000) / 5)
    assert stats.exact_prior([(5.0, 50_000, float(same.sum()), float((same**2).sum()) * 0.9)])[0] == math.inf


def test_exact_median(spark):
    rng = np.random.default_rng(5)
    for values in ([3.0], [1.0, 2.0], rng.random(5000).tolist(), [1.0] * 400 + rng.random(301).tolist(), rng.integers(0, 9, 900).astype(float).tolist()):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert stats.exact_median(df, "v", few=50) == pytest.approx(float(np.median(values)), abs=1e-12)


def test_order_and_matrices(toy):
    out = stats.calculate_diff_meth(toy, test="fisher").collect()
    assert [(r.pvalue, r.chr, r.start) for r in out] == sorted((r.pvalue, r.chr, r.start) for r in out)
    arrays = stats.site_arrays(toy, ["ctrl_1", "treat_1", "ctrl_2", "treat_2"]).toPandas()
    m, c = stats._matrices(arrays, 4)
    for i, r in arrays.iterrows():
        assert [m[i, s] for s in r["s"]] == list(r["m"]) and c[i].sum() == sum(r["c"])
    assert stats._matrices(arrays.iloc[:0], 4)[0].shape == (0, 4)


def test_annotating_a_cohort(spark, toy, tmp_path):
    (tmp_path / "f.bed").write_text("chr1\t900\t2500\tfirst\nchr1\t1000\t1001\tsecond\nchr2\t0\t600\tthird\n")
    out = intervals.annotate_cpg_islands(intervals.annotate_features(toy, str(tmp_path / "f.bed"), name_col=4), str(tmp_path / "f.bed"))
    got = {(r.chr, r.start): (r.feature, r.cpg_region) for r in out.sites.collect()}
    assert got["chr1", 1000] == ("first", "island") and got["chr2", 500] == ("third", "island") and got["chr1", 3000] == (None, "shore") and got["chr3", 9999] == (None, "open_sea")
    assert out.calls is toy.calls and len(got) == toy.n_sites


def test_products_of_blocks(toy):
    names = toy.obs_names
    rows = toy.calls.toPandas().pivot_table(index=["chr", "start"], columns="sample_id", values="beta")[names]
    x = rows.sub(rows.mean(axis=1), axis=0).fillna(0).to_numpy()
    got = {(r.i, r.j): r.g for r in qc.pca_gram(toy).collect()}
    want = x.T @ x
    assert got == {(a, b): pytest.approx(want[i, j], abs=1e-6) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j}
    one = toy.keep(toy.sites.where("chr = 'chr1' and start = 1000"))
    assert list(qc.pca(one, 3)[0].columns) == ["PC1"]
    table = qc.assoc_comp(toy, 2, pvalue_threshold=1.1)
    assert table.attrs["significant"].to_numpy().all() or table.isna().to_numpy().any()
