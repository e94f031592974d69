"""MethylFrame: an immutable cohort of calls, sites and samples."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methylake.sources.schema import CONTEXTS, KEY


@dataclass(frozen=True)
class MethylFrame:
    """Every method returns a new frame or a lazy DataFrame. Only the samples' number (a handful of rows) is ever counted on the way."""

    calls: DataFrame
    sites: DataFrame
    samples: DataFrame

    def __post_init__(self):
        for name, need in (("calls", {"sample_id", *KEY, "methylated", "coverage"}), ("sites", set(KEY)), ("samples", {"sample_id"})):
            if missing := need - set(getattr(self, name).columns):
                raise ValueError(f"{name} lacks {sorted(missing)}")

    # --- views ---------------------------------------------------------------

    @cached_property
    def n_samples(self) -> int:
        return self.samples.count()

    @property
    def n_sites(self) -> int:
        return self.sites.count()

    @property
    def obs_names(self) -> list[str]:
        return [r[0] for r in self.samples.select("sample_id").orderBy("sample_id").collect()]

    @property
    def var_names(self) -> DataFrame:
        return self.sites.select(F.concat_ws("", "chr", F.lit(":"), "start", F.lit("-"), "end").alias("name"))

    def layer(self, name: str) -> DataFrame:
        """One layer in long form: beta, coverage, methylated or unmethylated (coverage less methylated)."""
        value = F.col("coverage") - F.col("methylated") if name == "unmethylated" else F.col(name)
        return self.calls.select("sample_id", *KEY, value.alias(name))

    @property
    def beta(self) -> DataFrame:
        return self.layer("beta")

    @property
    def coverage(self) -> DataFrame:
        return self.layer("coverage")

    @property
    def methylated(self) -> DataFrame:
        return self.layer("methylated")

    @property
    def unmethylated(self) -> DataFrame:
        return self.layer("unmethylated")

    def dense(self) -> DataFrame:
        """A row for every sample and site; missing cells have zero counts and NULL beta. The samples, a small table, are broadcast."""
        grid = self.sites.select(*KEY).crossJoin(F.broadcast(self.samples.select("sample_id")))
        out = grid.join(self.calls.select("sample_id", *KEY, "methylated", "coverage", "beta"), ["sample_id", *KEY], "left")
        return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("methylated", "coverage")})

    def copy(self) -> MethylFrame:
        return replace(self)

    def __len__(self) -> int:
        return self.n_samples

    def __repr__(self) -> str:
        return f"MethylFrame({self.n_samples} samples; sites: {', '.join(self.sites.columns)})"

    # --- filters -------------------------------------------------------------

    def keep(self, sites: DataFrame) -> MethylFrame:
        """The frame at the sites whose keys are given."""
        keys = sites.select(*KEY)
        return replace(self, calls=self.calls.join(keys, KEY, "left_semi"), sites=self.sites.join(keys, KEY, "left_semi"))

    def where_samples(self, condition) -> MethylFrame:
        own = self.samples.where(condition)
        return MethylFrame(self.calls.join(own.select("sample_id"), "sample_id", "left_semi"), self.sites, own)

    def filter_coverage(self, min_cov: int = 1, max_cov: int | None = None, require_all_samples: bool = False) -> MethylFrame:
        """Sites where any sample (all, if asked for) reaches min_cov and none exceeds max_cov; missing cells count as 0."""
        enough = F.count_if(F.col("coverage") >= min_cov)
        need = F.lit(True) if min_cov <= 0 else enough >= (self.n_samples if require_all_samples else 1)
        top = F.lit(True) if max_cov is None else F.max("coverage") <= max_cov
        if min_cov <= 0 and (max_cov is None or max_cov >= 0):  # sites without calls pass too
            if max_cov is None:
                return self.copy()
            over = self.calls.groupBy(*KEY).agg(F.max("coverage").alias("c")).where(F.col("c") > max_cov)
            return self.keep(self.sites.join(over, KEY, "left_anti"))
        return self.keep(self.calls.groupBy(*KEY).agg((need & top).alias("ok")).where("ok"))

    def subset_context(self, context: str) -> MethylFrame:
        if context not in CONTEXTS:
            raise ValueError(f"context must be one of {CONTEXTS}")
        if "context" not in self.sites.columns:
            raise KeyError("context")
        own = self.sites.where(F.col("context") == context)
        calls = self.calls.where(F.col("context") == context) if "context" in self.calls.columns else self.calls.join(own.select(*KEY), KEY, "left_semi")
        return replace(self, calls=calls, sites=own)

    def unite(self, type: str = "intersect", min_per_group: int | None = None, treatment_col: str | None = None) -> MethylFrame:
        """union: as is. Otherwise sites covered in all samples or, with both other arguments, in min_per_group samples of every group (samples without a group are left out of account)."""
        if type == "union":
            return self.copy()
        if (min_per_group is None) != (treatment_col is None):
            raise ValueError("min_per_group and treatment_col go together")
        covered = self.calls.where("coverage > 0")
        if min_per_group is None:
            return self.keep(covered.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.n_samples))
        groups = [r[0] for r in self.samples.select(treatment_col).where(F.col(treatment_col).isNotNull()).distinct().collect()]
        tagged = covered.join(F.broadcast(self.samples.select("sample_id", F.col(treatment_col).alias("__g"))), "sample_id")
        per = [F.count_if(F.col("__g") == g) >= min_per_group for g in groups]
        ok = per[0] if per else F.lit(True)
        for p in per[1:]:
            ok = ok & p
        if min_per_group <= 0:
            return self.copy()
        return self.keep(tagged.groupBy(*KEY).agg(ok.alias("ok")).where("ok"))

    # --- summaries -----------------------------------------------------------

    def coverage_stats(self) -> DataFrame:
        """Per sample: mean_cov over all sites, median_cov over covered ones (0 without any), n_sites, n_sites_covered, pct_sites_covered."""
        n = self.sites.agg(F.count(F.lit(1)).alias("n_sites"))
        own = self.calls.where("coverage > 0").groupBy("sample_id").agg(F.sum("coverage").alias("s"), F.median("coverage").alias("m"), F.count(F.lit(1)).alias("c"))
        d = self.samples.select("sample_id").join(own, "sample_id", "left").crossJoin(n)
        covered = F.coalesce("c", F.lit(0).cast("long"))
        return d.select("sample_id", F.try_divide(F.coalesce("s", F.lit(0)), "n_sites").alias("mean_cov"), F.coalesce("m", F.lit(0.0)).alias("median_cov"), "n_sites", covered.alias("n_sites_covered"), F.try_divide(covered * 100.0, "n_sites").alias("pct_sites_covered"))

    def global_methylation(self) -> DataFrame:
        """Per sample: mean and median beta, total counts and their pooled percentage (NULL without coverage)."""
        own = self.calls.groupBy("sample_id").agg(F.avg("beta").alias("global_beta_mean"), F.median("beta").alias("global_beta_median"), F.sum("methylated").alias("m"), F.sum("coverage").alias("c"))
        d = self.samples.select("sample_id").join(own, "sample_id", "left")
        m, c = (F.coalesce(x, F.lit(0).cast("long")) for x in ("m", "c"))
        return d.select("sample_id", "global_beta_mean", "global_beta_median", m.alias("total_methylated"), c.alias("total_coverage"), F.try_divide(m * 100.0, c).alias("global_pct_meth"))
