"""Scratch tables in the folder that all executors share (``spark.checkpoint.dir``): they cut the lineage and are removed when the driver's JVM ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, tag: str) -> str:
    """A new path for scratch files. In local mode a folder is made if the setting is absent; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.methylake.scratch", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="methylake-")
        spark.conf.set("spark.methylake.scratch", base)
    out = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return out


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, computed once: written and read back."""
    path = folder(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
