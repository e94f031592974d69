"""Quality control: the data behind the figures, as DataFrames or small arrays (one row per sample)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from methylake.functions import special
from methylake.operators.cohort import MethylFrame
from methylake.sources.schema import KEY


def histogram(df: DataFrame, value: str, lo, hi, bins: int) -> DataFrame:
    """sample_id, bin (0-based), n for equal bins of lo..hi (columns or numbers); the last bin holds hi."""
    width = (F.col(hi) if isinstance(hi, str) else F.lit(float(hi))) - (F.col(lo) if isinstance(lo, str) else F.lit(float(lo)))
    place = F.floor(F.try_divide((F.col(value) - (F.col(lo) if isinstance(lo, str) else F.lit(float(lo)))) * bins, width))
    return df.withColumn("bin", F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int")).groupBy("sample_id", "bin").agg(F.count(F.lit(1)).alias("n"))


def coverage_hist(cohort: MethylFrame, max_cov: int = 200, bins: int = 100) -> DataFrame:
    """Per sample counts of covered sites by min(coverage, max_cov) over the sample's range, with the unclipped mean."""
    d = cohort.calls.where("coverage > 0").select("sample_id", F.least("coverage", F.lit(max_cov)).cast("double").alias("c"), "coverage")
    ends = d.groupBy("sample_id").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.avg("coverage").alias("mean_cov"))
    own = d.join(F.broadcast(ends), "sample_id")  # a row per sample
    return histogram(own, "c", "lo", "hi", bins).join(F.broadcast(ends), "sample_id")


def methylation_distribution(cohort: MethylFrame, plot_type: str = "violin", bins: int = 50) -> DataFrame:
    """violin and box: quantiles of beta per sample; hist: densities in equal bins of 0..100."""
    if plot_type not in ("violin", "box", "hist"):
        raise ValueError(f"unknown plot type {plot_type!r}")
    d = cohort.calls.where("beta is not null")
    if plot_type == "hist":
        h = histogram(d, "beta", 0, 100, bins)
        return h.withColumn("density", F.col("n") * (bins / 100.0) / F.sum("n").over(W.partitionBy("sample_id")))
    q = [0.0, 0.25, 0.5, 0.75, 1.0]
    return d.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.avg("beta").alias("mean"), *(F.percentile("beta", x).alias(f"q{int(x * 100)}") for x in q))


def _products(d: DataFrame, names: list[str]) -> DataFrame:
    """Sums of products v_i v_j over sites for sample pairs i <= j. Sites meet as arrays; a task sums X'X of its sites' matrices and returns one row a pair."""
    place = F.create_map(*[v for i, s in enumerate(names) for v in (F.lit(s), F.lit(i))])
    arrays = d.groupBy(*KEY).agg(F.collect_list(F.struct(place[F.col("sample_id")].alias("s"), "v")).alias("x")).select("x.s", "x.v")
    a, b = np.triu_indices(len(names))

    def run(it):
        total = np.zeros((len(names), len(names)))
        for p in it:
            x = np.zeros((len(p), len(names)))
            x[np.repeat(np.arange(len(p)), p["s"].map(len)), np.concatenate(p["s"].to_list())] = np.concatenate(p["v"].to_list())
            total += x.T @ x
        yield pd.DataFrame({"i": [names[k] for k in a], "j": [names[k] for k in b], "g": total[a, b]})

    return arrays.mapInPandas(run, "i string, j string, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def pca_gram(cohort: MethylFrame) -> DataFrame:
    """Gram matrix (i, j, g; i <= j) of the betas less their site mean; missing cells count as the mean."""
    mean = F.avg("beta").over(W.partitionBy(*KEY))
    return _products(cohort.calls.where("beta is not null").select("sample_id", *KEY, (F.col("beta") - mean).alias("v")), cohort.obs_names)


def _matrix(rows: DataFrame, names: list[str]) -> np.ndarray:
    at = {s: k for k, s in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    for r in rows.collect():
        out[at[r["i"]], at[r["j"]]] = out[at[r["j"]], at[r["i"]]] = r["g"]
    return out


def pca(cohort: MethylFrame, n_comps: int = 50) -> tuple[pd.DataFrame, np.ndarray]:
    """(scores by sample, shares of variance) from the samples' Gram matrix; each component's largest score is positive."""
    names = cohort.obs_names
    g = _matrix(pca_gram(cohort), names)
    g -= g.mean(0) + g.mean(1)[:, None] - g.mean()
    w, v = np.linalg.eigh(g)
    k = max(1, min(n_comps, min(len(names), cohort.sites.limit(len(names)).count()) - 1))
    top = np.argsort(w)[::-1][:k]
    w, v = np.maximum(w[top], 0), v[:, top]
    v *= np.where(v[np.abs(v).argmax(0), np.arange(k)] < 0, -1, 1)
    total = max(np.trace(g), 1e-300)
    return pd.DataFrame(v * np.sqrt(w), index=names, columns=[f"PC{i + 1}" for i in range(k)]), w / total


def correlation_table(cohort: MethylFrame, method: str = "pearson") -> DataFrame:
    """(i, j, g; i <= j) sums of products of deviations from the sample's mean; missing cells count as the mean. spearman ranks each sample, missing cells as its mean beta."""
    if method not in ("pearson", "spearman"):
        raise ValueError(f"unknown method {method!r}")
    if method == "pearson":
        means = cohort.calls.groupBy("sample_id").agg(F.avg("beta").alias("mu"))
        d = cohort.calls.where("beta is not null").join(F.broadcast(means), "sample_id")  # a row per sample
        return _products(d.select("sample_id", *KEY, (F.col("beta") - F.col("mu")).alias("v")), cohort.obs_names)
    means = cohort.calls.groupBy("sample_id").agg(F.avg("beta").alias("mu"))
    full = cohort.dense().join(F.broadcast(means), "sample_id").withColumn("b", F.coalesce("beta", "mu", F.lit(0.0)))
    # ranks from counts of different values: ties meet in partial sums
    c = full.groupBy("sample_id", "b").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.partitionBy("sample_id").orderBy("b").rowsBetween(W.unboundedPreceding, 0))
    ranks = c.withColumn("r", upto - (F.col("c") - 1) / 2.0).select("sample_id", "b", "r")
    mid = ranks.join(c, ["sample_id", "b"]).groupBy("sample_id").agg((F.sum(F.col("r") * F.col("c")) / F.sum("c")).alias("mid"))
    d = full.join(ranks, ["sample_id", "b"]).join(F.broadcast(mid), "sample_id")
    return _products(d.select("sample_id", *KEY, (F.col("r") - F.col("mid")).alias("v")), cohort.obs_names)


def correlation_pairs(cohort: MethylFrame, method: str = "pearson") -> DataFrame:
    """i, j, corr for all i <= j, NULL where a sample doesn't vary."""
    g = correlation_table(cohort, method)
    own = g.where("i = j")
    d = g.join(F.broadcast(own.select(F.col("i"), F.col("g").alias("gi"))), "i").join(F.broadcast(own.select(F.col("i").alias("j"), F.col("g").alias("gj"))), "j")
    return d.select("i", "j", F.try_divide("g", F.sqrt("gi") * F.sqrt("gj")).alias("corr"))


def sample_correlation(cohort: MethylFrame, method: str = "pearson") -> pd.DataFrame:
    """Correlation matrix of the samples, in the order of average linkage."""
    names = cohort.obs_names
    m = _matrix(correlation_pairs(cohort, method).withColumnRenamed("corr", "g").na.fill({"g": 0.0}), names)
    order = linkage_order(1 - m)
    return pd.DataFrame(m[np.ix_(order, order)], index=[names[i] for i in order], columns=[names[i] for i in order])


def linkage_order(dist: np.ndarray) -> list[int]:
    """Leaves in the order in which average linkage joins them."""
    parts = [[i] for i in range(len(dist))]
    while len(parts) > 1:
        _, a, b = min((dist[np.ix_(x, y)].mean(), i, j) for i, x in enumerate(parts) for j, y in enumerate(parts) if i < j)
        parts[a] += parts.pop(b)
    return parts[0] if parts else []


def kruskal(groups: list[np.ndarray]) -> float:
    """p-value of the Kruskal-Wallis test, with the correction for ties."""
    x = np.concatenate(groups)
    kinds, at, c = np.unique(x, return_inverse=True, return_counts=True)
    rank = (np.cumsum(c) - (c - 1) / 2)[at]
    n = len(x)
    parts = np.split(rank, np.cumsum([len(g) for g in groups])[:-1])
    h = 12 / (n * (n + 1)) * sum(p.sum() ** 2 / len(p) for p in parts) - 3 * (n + 1)
    fix = 1 - (c**3 - c).sum() / max(n**3 - n, 1)
    return float(special.chi2_sf(np.array([h / fix]), len(groups) - 1)[0]) if fix > 0 else float("nan")


def linear_p(x: np.ndarray, y: np.ndarray) -> float:
    """p-value of the slope of a simple regression."""
    n = len(x)
    if n < 3 or np.std(x) == 0 or np.std(y) == 0:
        return float("nan")
    r = float(np.clip(np.corrcoef(x, y)[0, 1], -1, 1))
    if abs(r) >= 1:
        return 0.0
    return float(special.t_sf2(np.array([r * np.sqrt((n - 2) / (1 - r * r))]), np.array([n - 2.0]))[0])


def assoc_comp(cohort: MethylFrame, n_comps: int = 10, metadata_cols: list[str] | None = None, scores: pd.DataFrame | None = None, pvalue_threshold: float = 0.05) -> pd.DataFrame:
    """p-values, components x metadata: Kruskal-Wallis for text or at most ten values, else linear regression. By default the columns with more than one value.

    attrs["significant"] has where they are below pvalue_threshold.
    """
    scores = pca(cohort, n_comps)[0] if scores is None else scores
    meta = cohort.samples.toPandas().set_index("sample_id").loc[scores.index]
    cols = metadata_cols or [c for c in meta.columns if meta[c].nunique() > 1]
    if not cols:
        raise ValueError("no metadata column varies")
    out = pd.DataFrame(index=scores.columns[:n_comps], columns=cols, dtype=float)
    for c in cols:
        known = meta[c].notna()
        for pc in out.index:
            y, v = scores.loc[known, pc].to_numpy(), meta.loc[known, c]
            if v.dtype == object or v.nunique() <= 10:
                parts = [y[(v == k).to_numpy()] for k in v.unique()]
                out.loc[pc, c] = kruskal(parts) if len(parts) > 1 else float("nan")
            else:
                out.loc[pc, c] = linear_p(v.to_numpy(float), y)
    out.attrs["significant"] = out < pvalue_threshold
    return out


def umap(cohort: MethylFrame, n_neighbors: int = 15, min_dist: float = 0.3, n_comps: int = 50, epochs: int = 200, seed: int = 0) -> pd.DataFrame:
    """Two-dimensional layout of the samples from their components: fuzzy nearest-neighbour graph, then attraction along edges and repulsion from random others."""
    scores = pca(cohort, n_comps)[0]
    x, n = scores.to_numpy(), len(scores)
    k = min(n_neighbors, n - 1)
    if k < 1:
        return pd.DataFrame(np.zeros((n, 2)), index=scores.index, columns=["UMAP1", "UMAP2"])
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = np.sort(dist, 1)[:, 1 : k + 1]
    rho = near[:, :1]
    sigma = np.maximum((near - rho).mean(1, keepdims=True), 1e-9)
    w = np.where(dist <= near[:, -1:], np.exp(-np.maximum(dist - rho, 0) / sigma), 0)
    np.fill_diagonal(w, 0)
    w = w + w.T - w * w.T
    rng = np.random.default_rng(seed)
    y = x[:, :2] if x.shape[1] > 1 else np.hstack((x, np.zeros((n, 1))))
    y = y / max(np.abs(y).max(), 1e-9) * 10 + rng.normal(0, 1e-2, (n, 2))
    a = 1 / max(min_dist, 1e-3)
    for e in range(epochs):
        rate = 1 - e / epochs
        diff = y[:, None] - y[None]
        d2 = (diff**2).sum(-1)
        pull = -2 * a * w / (1 + a * d2)
        push = (1 - w) * 2 / ((0.01 + d2) * (1 + a * d2)) / n
        y = y + rate * np.clip(((pull + push)[..., None] * diff), -4, 4).sum(1) * 0.1
    return pd.DataFrame(y, index=scores.index, columns=["UMAP1", "UMAP2"])
