"""N-gram Jaccard join by MinHash banding.

Words are lower-cased runs of other characters than ASCII white space; a text's n-grams
are its runs of five words (a shorter text is one n-gram). Bands and rows are chosen so
that a pair at the threshold shares a band with the target recall. Band hashes are
shuffled; texts that share one are verified on their full n-gram sets: they link if the
Jaccard similarity is at least the threshold.

Copies of a text form a class and are compared once. Texts without words (null, empty)
link with nothing, not even with each other. Ids may repeat or be null. Extra columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methylake.llm.common import Workspace, content_key, distinct_texts, join64, map_batches, mix64, with_tid
from methylake.llm.groups import links, members
from methylake.llm.repeats import tokens

NO_WORDS = "coalesce(text, '') not rlike '[^\\\\x20\\\\x09-\\\\x0D]'"


def banding(threshold: float, recall: float, most: int = 32) -> tuple[int, int]:
    """(bands, rows): the most rows for which at most `most` bands reach the recall at the threshold."""
    best = (1, 1)
    for rows in range(1, 20):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands <= most:
            best = (bands, rows)
    return best


def grams(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all n-grams, text after text, and the number in each text."""
    t, lens = tokens([x.lower() if x else "" for x in texts], "words")
    count = np.where(lens > 0, np.maximum(lens - n + 1, 1), 0)
    start = np.repeat(np.cumsum(lens) - lens, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    end = np.repeat(np.cumsum(lens), count)
    out = np.full(len(start), np.uint64(n))
    for k in range(n):
        at = start + k
        out = np.where(at < end, join64(out, t[np.minimum(at, len(t) - 1)]), out) if len(t) else out
    return out, count


def signatures(texts: list[str | None], n: int, bands: int, rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of texts with words, and their band hashes (texts x bands)."""
    g, count = grams(texts, n)
    some = np.flatnonzero(count)
    if not len(some):
        return some, np.empty((0, bands), np.uint64)
    at = (np.cumsum(count) - count)[some]
    h = (g >> np.uint64(32)).astype(np.uint32)
    coef = mix64(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) + np.uint64(seed << 32)).astype(np.uint32)
    out = np.empty((len(some), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(some), np.uint64(b + 1))
        for r in range(rows):
            k = 2 * (b * rows + r)
            acc = join64(acc, np.minimum.reduceat(h * (coef[k] | np.uint32(1)) + coef[k + 1], at).astype(np.uint64))
        out[:, b] = acc
    return some, out


def similar(sets: list[np.ndarray], threshold: float, width: int = 8192) -> np.ndarray:
    """Boolean matrix of pairs with Jaccard >= threshold; n-grams of one text alone need no column."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    kinds, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    keep = times[at] > 1
    owner, at = owner[keep], column[at[keep]]
    inter = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, b = np.searchsorted(at, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], at[a:b] - lo] = 1
        inter += m @ m.T
    union = sizes[:, None] + sizes[None, :] - inter
    return inter.astype(np.float64) >= threshold * union - 1e-9


def link_texts(ws: Workspace, texts: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, seed: int = 1) -> DataFrame:
    """texts (tid, copies, text), different from each other -> rows (tid, links, root) of those that link."""
    bands, rows = banding(threshold, recall)

    def sign(b):
        some, out = signatures(b.column(1).to_pylist(), n, bands, rows, seed)
        return {"tid": np.repeat(b.column(0).to_numpy()[some], bands), "band": out.ravel().view(np.int64)}

    keys = ws.put(map_batches(texts.select("tid", "text"), sign, "tid bigint, band bigint", 1 << 20), "bands")
    least = ws.put(keys.groupBy("band").agg(F.min("tid").alias("a"), F.max("tid").alias("z")).where("a <> z").select("band", "a"), "least")
    stars = keys.join(least, "band").select("a", F.col("tid").alias("b")).where("a <> b")
    cand = members(ws, stars, "j")

    def sets(b):
        at = b.schema.get_field_index
        g, count = grams(b.column(at("text")).to_pylist(), n)
        parts = np.split(g.view(np.int64), np.cumsum(count)[:-1])
        return {k: b.column(at(k)) for k in ("tid", "copies", "root", "blk", "spots")} | {"grams": [np.unique(p) for p in parts]}

    full = map_batches(texts.join(cand, "tid").select("tid", "copies", "root", "blk", "spots", "text"), sets, "tid bigint, copies bigint, root bigint, blk int, spots array<struct<g:bigint,i:int,j:int>>, grams array<bigint>", 1 << 20)
    out = links(ws, full, "grams", lambda s: similar(s, threshold), "j")
    ws.drop("bands")
    return out


def join(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, class_id (least id with the same text), n_links (other documents linked), component_id (least id reachable), kept."""
    ws = Workspace(docs.sparkSession, "jaccard")
    texts = distinct_texts(ws, docs)
    found = ws.put(link_texts(ws, texts, **how), "found")
    ws.drop("texts", "texts_apart")
    keyed = with_tid(ws, docs.select("doc_id", content_key().alias("key"), F.expr(NO_WORDS).alias("void")))
    cls = keyed.where("not void").groupBy("tid").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    cls = ws.put(cls.join(found, "tid", "left").select("tid", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "tid").alias("root")), "classes")
    low = ws.put(cls.groupBy("root").agg(F.min("class_id").alias("component_id")), "low")
    cls = ws.put(cls.join(low, "root").select("tid", "class_id", "n_links", "component_id"), "classified")
    linked = keyed.where("not void").join(cls, "tid").select("doc_id", "class_id", "n_links", "component_id")
    void = keyed.where("void").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(void).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def dedupe(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each component (that of the least id, ids before nulls); rows without words all stay. Columns as before."""
    ws = Workspace(docs.sparkSession, "jaccard")
    void = docs.where(F.expr(NO_WORDS))
    texts = distinct_texts(ws, docs.where(~F.expr(NO_WORDS)), whole=True)
    found = ws.put(link_texts(ws, texts, **how), "found")
    rank = texts.select("tid", F.col("row.o").alias("o")).join(found.select("tid", "root"), "tid")
    keeper = rank.groupBy("root").agg(F.min_by("tid", F.struct("o", "tid")).alias("tid"), F.lit(True).alias("first"))
    gone = found.select("tid").join(keeper.select("tid"), "tid", "left_anti")
    left = texts.join(gone, "tid", "left_anti")
    columns = [F.col("text") if c == "text" else F.col(f"row.c.`{c}`").alias(c) for c in docs.columns]
    ws.forget()
    return left.select(*columns).unionByName(void)
