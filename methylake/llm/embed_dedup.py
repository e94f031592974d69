"""Embedding near-dedup with randomised-rotation binary codes.

A unit vector o is rotated by a random orthogonal matrix; its code c is the signs of the
result over sqrt(D), and the stored correction is <c, Po>. For a query q the value
<c, Pq> / <c, Po> is an unbiased estimate of <o, q>, with an error of about
sqrt((1 - <c,Po>^2) / <c,Po>^2 / (D - 1)).

Candidates. Bits of the codes of several rotations are read in bands; vectors that share
a band are compared by their stored codes. The number of bands follows from the recall that
is asked for at the threshold, the bits per band from the number of vectors, so that
buckets stay small. What the codes leave open is compared again in groups, where every pair is estimated from codes; pairs whose upper bound
(eps standard errors) reaches the threshold are computed exactly in double precision,
and only the exact value decides.

Vectors that are null, empty, zero, or hold null, NaN or infinite components link with
nothing; so do vectors of different lengths. Equal vectors form a class and are compared
once. Ids may repeat or be null; repeated rows link with each other; extra columns and labels
are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methylake.llm.common import Workspace, join64, map_batches
from methylake.llm.groups import links, members

#: Buckets of up to so many vectors are compared pair by pair on their codes; in larger ones each vector is tied to the least one.
MANY = 128
OK = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"


@lru_cache(maxsize=64)
def rotation(dim: int, k: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, k]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits per band, bands) for n vectors."""
    bits = min(48, max(8, math.ceil(math.log2(max(n, 2)))))
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def bands(x: np.ndarray, bits: int, count: int, seed: int) -> np.ndarray:
    """Band hashes, vectors x bands; a rotation gives dim // bits bands."""
    dim = x.shape[1]
    width = min(bits, dim)
    per = dim // width
    out = np.empty((len(x), count), np.uint64)
    weight = np.uint64(1) << np.arange(width, dtype=np.uint64)
    for k in range(math.ceil(count / per)):
        code = (x @ rotation(dim, k + 1, seed).T > 0).astype(np.uint64)
        for j in range(min(per, count - k * per)):
            value = (code[:, j * width : (j + 1) * width] * weight).sum(1, dtype=np.uint64)
            out[:, k * per + j] = join64(np.full(len(x), np.uint64((k * per + j) << 16 | dim)), value)
    return out


def close(vectors: list[np.ndarray], threshold: float, eps: float, seed: int) -> np.ndarray:
    """Boolean matrix of pairs with cosine >= threshold: estimates and bounds first, exact values where they leave it open."""
    out = np.zeros((len(vectors), len(vectors)), bool)
    sizes = np.array([len(v) for v in vectors])
    for dim in np.unique(sizes):
        own = np.flatnonzero(sizes == dim)
        raw = np.stack([np.asarray(vectors[i], np.float64) for i in own])
        x = raw / np.abs(raw).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        turned = x @ rotation(int(dim), 0, seed).T
        code = np.where(turned > 0, 1.0, -1.0) / math.sqrt(dim)
        corr = (code * turned).sum(1)
        est = (code @ turned.T) / corr[:, None]
        err = eps * np.sqrt(np.maximum(1 - corr**2, 0) / corr**2 / max(dim - 1, 1))
        open_ = (est + err[:, None] >= threshold) | (est + err[:, None] >= threshold).T
        a, b = np.nonzero(np.triu(open_, 1))
        for lo in range(0, len(a), 65536):
            i, j = a[lo : lo + 65536], b[lo : lo + 65536]
            yes = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            out[own[i[yes]], own[j[yes]]] = out[own[j[yes]], own[i[yes]]] = True
    return out


def code_edges(pdf: pd.DataFrame, threshold: float, eps: float) -> pd.DataFrame:
    """Edges inside buckets between vectors whose codes differ in no more bits than a pair at the threshold does (plus eps deviations)."""
    pdf = pdf.sort_values(["band", "tid"])
    band, tid, code = (pdf[c].to_numpy() for c in ("band", "tid", "code"))
    width = np.minimum(pdf["dim"].to_numpy(), 64)
    p = math.acos(min(1.0, threshold)) / math.pi
    most = width * p + eps * np.sqrt(width * p * (1 - p))
    out = []
    for lag in range(1, len(band)):
        same = np.flatnonzero(band[lag:] == band[:-lag])
        if not len(same):
            break
        ok = same[np.bitwise_count((code[same] ^ code[same + lag]).view(np.uint64)) <= most[same]]
        out.append(np.stack((tid[ok], tid[ok + lag]), 1))
    edges = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
    return pd.DataFrame(edges, columns=["a", "b"])


def near(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.998, eps: float = 4.0, seed: int = 3) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, n_links, component_id (least id reachable), kept."""
    ws = Workspace(vectors.sparkSession, "embed")
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("ok", F.expr(OK))
    # a class is named by 128 bits of its vector, and numbered when the classes are written
    keyed = v.select("vec_id", "ok", F.when(F.col("ok"), F.xxhash64("embedding")).alias("k1"), F.when(F.col("ok"), F.xxhash64(F.lit(seed), "embedding", F.lit(~seed))).alias("k2"), "embedding")
    cls = keyed.where("ok").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("class_id"), F.first("embedding").alias("embedding"))
    cls = ws.put(cls.withColumn("tid", F.monotonically_increasing_id()), "classes")
    keyed = keyed.select("vec_id", "k1", "k2")
    bits, count = plan(cls.count(), threshold, recall)

    def sign(b):
        lists = b.column(1)
        n = lists.value_lengths().to_numpy()
        flat = lists.flatten().to_numpy()
        tid, at, ids, out, codes = b.column(0).to_numpy(), np.cumsum(n) - n, [], [], []
        for dim in np.unique(n):
            own = np.flatnonzero(n == dim)
            x = flat[at[own][:, None] + np.arange(dim)]
            x = x / np.abs(x).max(1, keepdims=True)
            ids.append(np.repeat(tid[own], count))
            out.append(bands(x, bits, count, seed).ravel())
            bit = x @ rotation(int(dim), 0, seed).T[:, :64] > 0
            codes.append(np.repeat((bit * (np.uint64(1) << np.arange(bit.shape[1], dtype=np.uint64))).sum(1, dtype=np.uint64), count))
        return {"tid": np.concatenate(ids), "band": np.concatenate(out).view(np.int64), "code": np.concatenate(codes).view(np.int64), "dim": np.repeat(np.concatenate([n[n == d] for d in np.unique(n)]), count).astype(np.int32)}

    keys = ws.put(map_batches(cls.select("tid", "embedding"), sign, "tid bigint, band bigint, code bigint, dim int"), "bands")
    least = ws.put(keys.groupBy("band").agg(F.min("tid").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1"), "least")
    shared = ws.put(keys.join(least, "band"), "shared")
    stars = shared.where(F.col("n") > MANY).select("a", F.col("tid").alias("b")).where("a <> b")
    few = shared.where(F.col("n") <= MANY)
    bins = max(1, math.ceil(few.count() / 20_000))
    grouped = few.select("band", "tid", "code", "dim", F.pmod(F.xxhash64("band"), F.lit(bins)).alias("bin")).groupBy("bin")
    pairs = grouped.applyInPandas(lambda pdf: code_edges(pdf, threshold, eps), "a bigint, b bigint")
    cand = members(ws, ws.put(stars.unionByName(pairs).distinct(), "edges"), "e")
    full = cls.select("tid", "copies", "embedding").join(cand, "tid")
    found = ws.put(links(ws, full, "embedding", lambda s: close(s, threshold, eps, seed), "e"), "found")
    ws.drop("bands", "shared", "least")
    info = cls.select("tid", "k1", "k2", "class_id", "copies").join(found, "tid", "left").select("tid", "k1", "k2", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "tid").alias("root"))
    info = ws.put(info, "info")
    low = ws.put(info.groupBy("root").agg(F.min("class_id").alias("component_id")), "low")
    info = ws.put(info.join(low, "root").select("k1", "k2", "n_links", "component_id"), "joined")
    out = keyed.join(info, ["k1", "k2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
