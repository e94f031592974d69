"""Suffix-array dedup by distributed prefix doubling, on UTF-8 bytes.

Suffixes are ranked by growing prefixes. A round takes, for each suffix that is left, the
pair of its own rank and that of the suffix `step` bytes on; Spark sorts the pairs over
range partitions, and equal neighbours get one rank (dense, continued over the partitions'
borders). Suffixes whose pair is unique leave. For 200 bytes the first ranks are names of
50 bytes, made in each text, and the rounds are at 50 and at 100. Hot pairs are dealt over
many partitions, as the text's id sorts behind the pair.

Which suffixes are ranked is decided without losing any: the seeds of
:mod:`methylake.llm.repeats` (least-named 50 bytes near each window's start, of which only
those that occur again are left) stand for runs of neighbouring window starts; the first
and the last window of a run are ranked, and the seed itself by 100 bytes. A last round
sorts the pairs of a run's first and last rank: a run whose pair occurs again repeats as a
whole. Where a seed has other occurrences but its run's pair is unique, the run's windows
are ranked one by one, by the pair of names of their halves, against one run of each other
pair of that seed.

Every byte covered by a 200-byte string that also starts elsewhere is removed; matches
never cross texts. Null texts are empty. Copies of one text remove each other. Texts
shorter than the threshold lose nothing. Repeated rows get equal rows. Extra columns are
ignored. A threshold under 4 bytes or over some 130,000 is a ValueError.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methylake.llm.common import Workspace, claim, join64, map_batches
from methylake.llm.repeats import BATCH, Spec, _flat, _texts, _tids, covered, doubtful, names, survivors, sweep, tokens, unpack


def steps(spec: Spec) -> list[int]:
    """Offsets of the rounds that lead from prefixes of a seed's length to the whole length."""
    out, have = [], spec.seed
    while have < spec.length:
        out.append(min(have, spec.length - have))
        have += out[-1]
    return out


def ranked(ws: Workspace, pairs: DataFrame, name: str, unique: bool = False) -> DataFrame:
    """pairs (a, b, tid, at, more), a written table: tid, at, more and the dense rank of (a, b), for pairs that occur twice or more; with unique also the others, rank null.

    A partition returns its rows with ranks of its own and one row on its ends; the driver
    sees those (one for each partition) and returns each partition's first rank.
    """
    n = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("tid", pa.int64()), ("at", pa.int64()), ("more", pa.int64()), ("rank", pa.int64()), ("edge", pa.int8()), ("part", pa.int32()), ("ends", pa.list_(pa.int64()))])

    def batch(columns, ends=None):
        tid, at, more, rank, edge = columns
        size, part = len(tid), TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays([pa.array(tid), pa.array(at), pa.array(more), pa.array(rank), pa.array(edge, pa.int8()), pa.array(np.full(size, part, np.int32)), pa.nulls(size, pa.list_(pa.int64())) if ends is None else pa.array([ends], pa.list_(pa.int64()))], schema=schema)

    def run(it):
        claim(__name__)
        held, first, before, rank = None, None, None, -1
        for b in it:
            if not b.num_rows:
                continue
            new = [c.to_numpy() for c in b.columns]
            a, b_, tid, at, more = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            start = np.append(True if before is None else (a[0], b_[0]) != before, (a[1:] != a[:-1]) | (b_[1:] != b_[:-1]))
            ranks = rank + np.cumsum(start)
            first = first or (int(a[0]), int(b_[0]))
            # the last row is held until the next one is seen
            lone = start[:-1] & start[1:]
            edge = np.where(lone, 4, 0).astype(np.int8)
            if before is None and len(edge):
                edge[0] = 1 if lone[0] else 0
            keep = slice(None) if unique else edge < 4
            yield batch([x[:-1][keep] for x in (tid, at, more, ranks)] + [edge[keep]])
            if len(a) > 1:
                before = int(a[-2]), int(b_[-2])
            rank = int(ranks[-1]) - int(start[-1])
            held = [x[-1:] for x in (a, b_, tid, at, more)]
        if held is not None:
            last = int(held[0][0]), int(held[1][0])
            alone = last != before
            rank += alone
            edge = np.array([0 if not alone else 3 if before is None else 2], np.int8)
            yield batch([held[2], held[3], held[4], np.array([rank]), edge])
            yield batch([np.array([0])] * 4 + [np.array([0], np.int8)], [rank + 1, *first, *last])

    ordered = pairs.select("a", "b", "tid", "at", "more").repartitionByRange(n, "a", "b", "tid").sortWithinPartitions("a", "b")
    found = ws.put(ordered.mapInArrow(run, "tid bigint, at bigint, more bigint, rank bigint, edge tinyint, part int, ends array<bigint>"), name)
    base, rows, last = 0, [], None
    told = sorted((r["part"], list(r["ends"])) for r in found.where("ends is not null").select("part", "ends").collect())
    for k, (part, (groups, *ends)) in enumerate(told):
        joined = last == ends[:2]
        base -= joined
        after = told[k + 1][1][1:3] if k + 1 < len(told) else None
        rows.append((part, base, joined, ends[2:] == after))
        base, last = base + groups, ends[2:]
    borders = ws.spark.createDataFrame(rows, "part int, base bigint, joins boolean, goes boolean")
    # edge: 1 the first row, 2 the last one, 3 both, 4 any other that is alone in its partition
    same = (F.col("edge") == 0) | (F.col("edge").isin(1, 3) & F.col("joins")) | (F.col("edge").isin(2, 3) & F.col("goes"))
    out = found.where("ends is null").join(F.broadcast(borders), "part")
    out = out.select("tid", "at", "more", F.when(same, F.col("base") + F.col("rank")).alias("rank"))
    return out if unique else out.where("rank is not null")


def repeated(ws: Workspace, texts: DataFrame, spec: Spec) -> DataFrame:
    """Rows (tid, cover array<long>): windows starting in first..last repeat, packed as first << 32 | last."""
    offsets = steps(spec)
    places = ws.put(survivors(ws, texts, spec), "places")
    ws.drop("level1")

    def ends(place: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
        """Seeds, first windows, and the windows that end the runs: the next run's first one if that run follows at once."""
        order = np.lexsort((place, row))
        place, row = place[order], row[order]
        a, lo, hi = unpack(place)
        follows = np.append((row[1:] == row[:-1]) & (lo[1:] == hi[:-1] + 1), False)
        return row, place, a, lo, np.where(follows, hi + 1, hi)

    def begin(b):
        t, lens = tokens(_texts(b), spec.kind)
        run = names(t, spec.seed)
        row, _, a, lo, end = ends(*_flat(b, "places"))
        base = np.cumsum(lens) - lens
        # level k of a suffix: it takes part in the rounds up to k
        at = np.unique(np.concatenate((base[row] + lo, base[row] + end)))
        level = np.full(len(at), len(offsets))
        for k in range(len(offsets) - 1, 0, -1):
            more = np.setdiff1d(at[level > k] + offsets[k], at)
            at, level = np.append(at, more), np.append(level, np.full(len(more), k))
        seed = np.unique(base[row] + a)
        extra = np.setdiff1d(seed, at)
        at, level = np.append(at, extra), np.append(level, np.ones(len(extra), np.int64))
        text = np.searchsorted(np.cumsum(lens), at, "right")
        return {"a": run[at].view(np.int64), "b": run[at + offsets[0]].view(np.int64), "tid": _tids(b)[text], "at": at - base[text], "more": level * 2 + np.isin(at, seed)}

    pair = "a bigint, b bigint, tid bigint, at bigint, more bigint"
    first = ws.put(map_batches(texts.select("tid", "text").join(places, "tid"), begin, pair, BATCH), "pairs0")
    ranks = by_seed = ranked(ws, first, "ranks0")
    ws.free()
    for k, step in list(enumerate(offsets))[1:]:

        def further(b, k=k, step=step):
            """Pairs at the next offset, of the suffixes of this level whose partner is left too."""
            at, row = _flat(b, "at")
            rank, _ = _flat(b, "rank")
            more, _ = _flat(b, "more")
            order = np.lexsort((at, row))
            at, row, rank, more = at[order], row[order], rank[order], more[order]
            key = row << 32 | at
            own = np.flatnonzero(more // 2 > k)
            other = np.searchsorted(key, key[own] + step)
            ok = other < len(key)
            ok[ok] = key[other[ok]] == key[own[ok]] + step
            own, other = own[ok], other[ok]
            return {"a": rank[own], "b": rank[other], "tid": _tids(b)[row[own]], "at": at[own], "more": more[own]}

        listed = ranks.groupBy("tid").agg(F.collect_list(F.struct("at", "rank", "more")).alias("x")).select("tid", "x.at", "x.rank", "x.more")
        ranks = ranked(ws, ws.put(map_batches(listed, further, pair, BATCH), f"pairs{k}"), f"ranks{k}")
        ws.drop(f"pairs{k - 1}")

    def runs(b):
        """Each run whose seed occurs again, with its first and last rank (a is -1 where one of them is unique)."""
        row, place, a, lo, end = ends(*_flat(b, "places"))

        def rank_at(at, x, y):
            own, of = _flat(b, x)
            values, _ = _flat(b, y)
            if not len(own):
                return np.full(len(at), -1)
            order = np.argsort(of << 32 | own)
            key = (of << 32 | own)[order]
            i = np.minimum(np.searchsorted(key, row << 32 | at), len(key) - 1)
            return np.where(key[i] == (row << 32 | at), values[order][i], -1)

        g, x, y = rank_at(a, "s_at", "s_rank"), rank_at(lo, "w_at", "w_rank"), rank_at(end, "w_at", "w_rank")
        ok = g >= 0
        both = (x >= 0) & (y >= 0)
        return {"a": np.where(both, x, -1)[ok], "b": np.where(both, y << 17 | end - lo, 0)[ok], "tid": _tids(b)[row][ok], "at": place[ok], "more": g[ok]}

    seeds = by_seed.where("more % 2 = 1").groupBy("tid").agg(F.collect_list(F.struct("at", "rank")).alias("s")).select("tid", F.col("s.at").alias("s_at"), F.col("s.rank").alias("s_rank"))
    windows = ranks.groupBy("tid").agg(F.collect_list(F.struct("at", "rank")).alias("w")).select("tid", F.col("w.at").alias("w_at"), F.col("w.rank").alias("w_rank"))
    told = ws.put(map_batches(places.join(seeds, "tid").join(windows, "tid", "left"), runs, pair, BATCH), "runs")
    ws.drop("pairs0", *(f"pairs{k}" for k in range(1, len(offsets))), *(f"ranks{k}" for k in range(len(offsets))), "places")
    ws.free()
    place = (F.col("at").alias("place"), F.col("more").alias("g"))
    done = ranked(ws, told.where("a >= 0"), "contexts", unique=True)
    whole = done.where("rank is not null").select("tid", *place, "rank")
    alone = ws.put(done.where("rank is null").select("tid", *place).unionByName(told.where("a < 0").select("tid", *place)), "alone")
    open_ = ws.put(alone.select("g").distinct(), "open")
    others = whole.join(open_, "g", "left_semi").groupBy("g", "rank").agg(F.min(F.struct("tid", "place")).alias("one"))
    doubt = ws.put(alone.select("tid", "place", F.lit(True).alias("alone")).unionByName(others.select("one.*", F.lit(False).alias("alone"))), "doubt")

    def halves(run, p, spec):
        """Names of the two prefixes that make up a window in the last round."""
        starts = [0]
        for step in offsets[:-1]:
            starts += [x + step for x in starts]
        out = [np.full(len(p), np.uint64(spec.length)) for _ in range(2)]
        for k, first in enumerate((0, offsets[-1])):
            for x in starts:
                out[k] = join64(out[k], run[p + first + x])
        return tuple(out)

    left = doubtful(ws, texts, doubt, spec, halves)
    each = left.select(F.col("w1").alias("a"), F.col("w2").alias("b"), "tid", F.col("p").alias("at"), F.col("alone").cast("long").alias("more"))
    again = ranked(ws, each, "again").where("more = 1").select("tid", F.col("at").alias("p"))
    return covered(whole.select("tid", "place"), again)


def remove_repeated(docs: DataFrame, length: int = 200, keep: tuple[str, ...] = ("doc_id",), with_bytes: bool = False) -> DataFrame:
    """Kept columns, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if asked for, kept_bytes."""
    spec = Spec("bytes", length, length // 4)

    def render(text, mask):
        raw = text.encode("utf-8", "surrogatepass")
        left = np.frombuffer(raw, np.uint8)[~mask].tobytes() if mask.any() else raw
        spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if len(mask) else 0
        out = {"n_bytes": len(raw), "n_removed": int(mask.sum()), "n_spans": spans, "kept_sha256": hashlib.sha256(left).hexdigest()}
        return out | ({"kept_bytes": left} if with_bytes else {})

    return sweep(docs, spec, render, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_bytes binary" * with_bytes, keep, "suffix", repeated)
