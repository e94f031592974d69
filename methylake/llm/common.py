"""Shared plumbing of the training-data operators: scratch tables, row batching, hashing, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Workspace:
    """Scratch tables in the folder that ``spark.checkpoint.dir`` names.

    A table written here cuts the lineage: a lost executor costs a re-read, not a
    recomputation. Where the setting is absent a folder is made in local mode (tests); on a
    cluster that is an error, as executors would write where others cannot read. Everything
    is removed when the driver's JVM ends; :meth:`drop` removes a table earlier.
    """

    def __init__(self, spark: SparkSession, tag: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.methylake.scratch", None)
        if not base:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="methylake-")
            spark.conf.set("spark.methylake.scratch", base)
        self.spark = spark
        self.root = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"
        self._fs().deleteOnExit(self._path(self.root))
        self.tables: dict[str, str] = {}
        self.names: set[str] = set()

    def _path(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns it as read back."""
        self.names.add(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def put_bucketed(self, df: DataFrame, name: str, col: str, mode: str = "overwrite") -> DataFrame:
        """Writes df in buckets of col, as many as shuffle partitions: later joins on col don't shuffle it.

        The catalog's entry is a temporary one of this workspace; :meth:`drop` and :meth:`forget` remove it.
        """
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.names.add(name)
        table = self.tables.setdefault(name, f"scratch_{self.root.rsplit('-', 1)[1]}_{name}")
        df.write.mode(mode).format("parquet").option("compression", "zstd").option("path", self.path(name)).bucketBy(n, col).saveAsTable(table)
        return self.spark.table(table)

    def forget(self) -> None:
        """Takes this workspace's tables out of the session's catalog. Plans that were made from them still read their files."""
        for name in list(self.tables):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")

    def free(self) -> None:
        """Lets Spark remove the shuffle files of finished steps now, not at the driver's next full collection."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for n in names:
            if n in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(n)}")
            self._fs().delete(self._path(self.path(n)), True)
            self.names.discard(n)

    def drop_all_but(self, *names: str) -> None:
        """Removes every table that a result still to be computed doesn't read."""
        self.drop(*sorted(self.names - set(names)))


def text_batches(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each slice holds about max_bytes at most (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        step = max(1, int(b.num_rows * max_bytes / max(b.nbytes, 1)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


#: Rows of an Arrow batch; long texts are cut further by bytes.
ROWS = 1000
_release: dict[str, Callable[[], None]] = {}
_owner = ""


def on_release(module: str, clear: Callable[[], None]) -> None:
    """Registers how a module's caches are emptied."""
    _release[module] = clear


def claim(module: str) -> None:
    """Python workers are reused: when another operator takes one over, the caches of the last one go, and their memory with them."""
    global _owner
    if module == _owner:
        return
    for name, clear in _release.items():
        if name != module:
            clear()
    if _owner:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
    _owner = module


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str, max_bytes: int = 4 << 20) -> DataFrame:
    """mapInArrow over byte-bounded slices; fn returns a dict of column -> values (None: no rows)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)  # bounds what the JVM and Python hold at once
    names = _parse_datatype_string(schema)
    target = to_arrow_schema(names)

    def run(it):
        claim(fn.__module__)
        for b in text_batches(it, max_bytes):
            out = fn(b)
            if out is None:
                continue
            arrays = [a if isinstance(a := out[f.name], pa.Array) else pa.array(a, f.type) for f in target]
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def join64(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes: the name of a window from the names of its halves."""
    return mix64(a * _M1 + (b ^ (b >> np.uint64(29))) * _M3 + _M2)


def content_key(col: str = "text"):
    """128-bit key of a text's content (null like empty)."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(col), F.lit("")), 256)), 1, 16)


def distinct_texts(ws: Workspace, docs: DataFrame, whole: bool = False) -> DataFrame:
    """One row per different text: tid long, copies long, text string; in buckets of tid.

    tid is a 63-bit hash of the text's content. Different texts that share one (that shows
    in 128 bits of their content) get negative ids of their own instead, which nothing else
    has; only those texts are read again. Copies meet in partial aggregates, so a hot group
    never lands in one task; the aggregate's partitions are the buckets. whole adds row
    struct<o, c>: c the other columns of the copy that comes first by o (ids before nulls).
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    row = [F.struct(F.struct(F.col("doc_id").isNull(), "doc_id").alias("o"), F.struct(*rest).alias("c")).alias("row")] if whole else []
    d = docs.select(content_key().alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *row).withColumn("tid", text_id(F.col("key")))
    parts = [F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"), *[F.min("row").alias("row") for _ in row]]
    one = d.groupBy("tid").agg(*parts, (F.min("key") != F.max("key")).alias("clash"))
    got = ws.put_bucketed(one, "texts", "tid")
    ws.clashes = None
    if not (twice := got.where("clash").select("tid")).isEmpty():
        own = d.join(ws.put(twice, "twice"), "tid", "left_semi").groupBy("key").agg(*parts)
        own = ws.put(own.withColumn("tid", -1 - F.monotonically_increasing_id()), "apart")
        ws.clashes = own.select("key", F.col("tid").alias("own"))
        got = ws.put_bucketed(got.where("not clash").unionByName(own.drop("key").withColumn("clash", F.lit(False))), "texts_apart", "tid")
    ws.free()
    return got.drop("clash")


def with_tid(ws: Workspace, df: DataFrame) -> DataFrame:
    """df with the tid of its key, as distinct_texts gave it."""
    df = df.withColumn("tid", text_id(F.col("key")))
    if ws.clashes is not None:
        df = df.join(ws.clashes, "key", "left").withColumn("tid", F.coalesce("own", "tid")).drop("own")
    return df.drop("key")


def packed(columns) -> F.Column:
    """Some columns as one struct, out of the way of the names that an operator uses."""
    return F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.lit(None).cast("int")


def unpacked(name: str, columns) -> list:
    return [F.col(f"{name}.`{c}`").alias(c) for c in columns]


def text_id(key) -> F.Column:
    return F.xxhash64(key).bitwiseAND((1 << 63) - 1)


def components(ws: Workspace, edges: DataFrame, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the least node reached; nodes without edges are absent.

    Alternating large-star and small-star steps; every round is written to the workspace.
    Only a two-number aggregate comes back to the driver.
    """
    e = ws.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{tag}0")
    last, sign = f"{tag}0", None
    for k in range(1, max_rounds + 1):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # tables of their own: only then can Spark split a hub's rows on the other side of the join
        low = ws.put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{tag}low{k}")
        # large star: larger neighbours move to the least of the neighbourhood
        large = ws.put(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), f"{tag}large{k}")
        # small star: smaller neighbours and the node itself move to the least
        low2 = ws.put(large.groupBy("u").agg(F.min("v").alias("m")), f"{tag}least{k}")
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low2.select("u", F.col("m").alias("v"))).distinct()
        name = f"{tag}{k}"
        e = ws.put(small, name)
        ws.drop(last, f"{tag}low{k}", f"{tag}large{k}", f"{tag}least{k}")
        last = name
        now = e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.count_distinct("u")).first()
        if tuple(now) == sign and now[0] == now[2]:
            break
        sign = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
