import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("OMP_NUM_THREADS", "1")

import pytest  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": str(shared / "warehouse")}
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def toy(spark):
    """Four samples, ten sites: the layout of a small two-group study."""
    import numpy as np

    from methylake.operators.cohort import MethylFrame
    from methylake.sources.schema import CALL_COLUMNS

    rng = np.random.default_rng(42)
    loci = [("chr1", s) for s in (1000, 2000, 3000, 5000, 8000)] + [("chr2", s) for s in (500, 1500, 4000)] + [("chr3", s) for s in (100, 9999)]
    names = [("ctrl_1", "control", "A"), ("ctrl_2", "control", "A"), ("treat_1", "treatment", "B"), ("treat_2", "treatment", "B")]
    rows = []
    for s, g, _ in names:
        for k, (c, p) in enumerate(loci):
            cov = int(rng.integers(10, 50))
            beta = rng.uniform(20, 80) if k > 2 else (30 if g == "control" else 70)
            m = int(round(beta / 100 * cov))
            rows.append((s, c, p, p + 1, "+", "CpG", m, cov - m, cov, 100.0 * m / cov))
    calls = spark.createDataFrame(rows, "sample_id string, chr string, start bigint, end bigint, strand string, context string, methylated bigint, unmethylated bigint, coverage bigint, beta double").select(*CALL_COLUMNS)
    sites = calls.select("chr", "start", "end", "strand", "context").distinct()
    return MethylFrame(calls, sites, spark.createDataFrame(names, "sample_id string, group string, batch string"))
