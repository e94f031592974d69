"""Exact links inside candidate groups, without ever listing a group's pairs.

Candidate pairs come as stars (a bucket's least member with each other member). The
connected groups of stars hold every candidate pair. Small groups share a task; a group
of more than `block` members is cut into blocks, and each pair of blocks is a task of its
own, so the largest task is bounded whatever the group. A task compares its members as
matrices and returns, for each member, how many others it links with and one edge to the
least member that it reaches there: linear output, no lost link.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methylake.llm.common import Workspace, components

BLOCK = 256


def reach(adj: np.ndarray) -> np.ndarray:
    """Least index that each node reaches in a symmetric boolean matrix."""
    n = len(adj)
    label = np.arange(n)
    if not adj.any():
        return label
    full = adj | np.eye(n, dtype=bool)
    while True:
        new = np.where(full, label[None, :], n).min(1)
        if (new == label).all():
            return label
        label = new


def members(ws: Workspace, stars: DataFrame, tag: str, block: int = BLOCK) -> DataFrame:
    """Rows (tid, spots array<struct<g, root, i, j, blk>>): the tasks that each candidate takes part in."""
    comp = ws.put(components(ws, stars, f"{tag}cand"), f"{tag}comp")
    total = comp.count()
    bins = max(1, math.ceil(total / (block / 2)))
    sizes = ws.put(comp.groupBy("root").agg(F.count(F.lit(1)).alias("size")), f"{tag}sizes")
    n = F.ceil(F.col("size") / block).cast("int")
    m = comp.join(sizes, "root").select(F.col("node").alias("tid"), "root", n.alias("n"), F.pmod(F.xxhash64("node"), n.cast("long")).cast("int").alias("blk"))
    alone = F.array(F.struct(F.pmod(F.xxhash64("root"), F.lit(bins)).alias("g"), F.lit(0).alias("i"), F.lit(0).alias("j")))

    def spot(x):
        i, j = F.least(x, F.col("blk")), F.greatest(x, F.col("blk"))
        return F.struct(F.xxhash64("root", i, j).alias("g"), i.alias("i"), j.alias("j"))

    many = F.transform(F.sequence(F.lit(0), F.col("n") - 1), spot)
    return m.select("tid", "root", "blk", F.when(F.col("n") == 1, alone).otherwise(many).alias("spots"))


def links(ws: Workspace, candidates: DataFrame, payload: str, link: Callable[[list], np.ndarray], tag: str) -> DataFrame:
    """candidates: (tid, copies, root, blk, spots, payload). Rows (tid, links, root): number of linked originals (copies counted) and the least tid of the exact component; tids without links are absent."""
    rows = candidates.select("tid", "copies", "root", "blk", payload, F.explode("spots").alias("s")).select("tid", "copies", "root", "blk", payload, "s.*")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, i, j), part in pdf.groupby(["root", "i", "j"], sort=False):
            if len(part) < 2:
                continue
            part = part.sort_values("tid")
            adj = link(part[payload].tolist())
            np.fill_diagonal(adj, False)
            if i != j:
                blk = part["blk"].to_numpy()
                adj &= blk[:, None] != blk[None, :]
            n = adj.astype(np.float64) @ part["copies"].to_numpy(np.float64)
            tid = part["tid"].to_numpy()
            hit = adj.any(1)
            out.append(pd.DataFrame({"tid": tid[hit], "links": n[hit].astype(np.int64), "to": tid[reach(adj)][hit]}))
        return pd.concat(out) if out else pd.DataFrame({"tid": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "to": pd.Series(dtype="int64")})

    found = ws.put(rows.groupBy("g").applyInPandas(work, "tid bigint, links bigint, to bigint"), f"{tag}links")
    root = components(ws, found.select(F.col("tid").alias("a"), F.col("to").alias("b")), f"{tag}cc").select(F.col("node").alias("tid"), "root")
    return found.groupBy("tid").agg(F.sum("links").alias("links")).join(root, "tid")
