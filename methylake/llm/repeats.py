"""Repeated windows of a fixed number of tokens over a whole corpus, exactly.

A window is length tokens of one text. Names (64-bit hashes) of short runs are built by
doubling: the name of 2L tokens at i is made of those of L tokens at i and at i + L.

Seeds. Of the seed-long runs that start in the first `reach` places of a window, the one
with the least name (leftmost of equal ones) is the window's seed. It depends on the
window's content alone, so equal windows have equal seeds, in the same place; and as
neighbouring windows mostly share a seed, few places of a text are seeds. With
reach = length - 2 * seed + 1 the run of 2 * seed tokens from a seed is inside the window.

Levels. (1) Seeds whose name occurs once are dropped. (2) What is left is extended to
twice the length; names that occur once are dropped. (3) A seed stands for a run of
window starts; together they span a context. Contexts that occur twice or more repeat
all their windows. (4) Where a group of equal double seeds also has contexts that occur
once, its different contexts are extended to either side in steps of half a seed; as far
as the extensions repeat, their single windows are compared.

Only names, places and counts are shuffled, and counts are summed before the shuffle.
Texts stay in their buckets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methylake.llm.common import Workspace, join64, map_batches, mix64, on_release

BATCH = 1 << 20
#: Bits of each of the two distances packed with a place, and the largest distance.
BITS = 16
FIELD = (1 << BITS) - 1
_words: dict[bytes, int] = {}
on_release(__name__, _words.clear)


@dataclass(frozen=True)
class Spec:
    """kind: 'words' or 'bytes'."""

    kind: str
    length: int
    seed: int

    def __post_init__(self):
        if self.seed < 1 or self.length < 3 * self.seed:
            raise ValueError(f"windows of {self.length} {self.kind} are too short")
        if self.reach > FIELD:
            raise ValueError(f"windows of {self.length} {self.kind} are too long")

    @property
    def reach(self) -> int:
        return self.length - 2 * self.seed + 1

    @property
    def step(self) -> int:
        return max(1, self.seed // 2)


def split_words(text: str | None) -> list[bytes]:
    """Runs of other characters than blank, tab, line feed, vertical tab, form feed and return."""
    return (text or "").encode("utf-8", "surrogatepass").split()


@lru_cache(maxsize=1)
def _byte_names() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def tokens(texts: list[str | None], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Names of all tokens, text after text, and the number of each text's tokens."""
    if kind == "bytes":
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        return _byte_names()[np.frombuffer(b"".join(raw), np.uint8)], np.fromiter(map(len, raw), np.int64, len(raw))
    parts = [split_words(t) for t in texts]
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    new = [w for w in set(chain.from_iterable(parts)) if w not in _words]
    if len(_words) + len(new) > 400_000:
        _words.clear()
        new = list(set(chain.from_iterable(parts)))
    _words.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
    return np.fromiter(map(_words.__getitem__, chain.from_iterable(parts)), np.uint64, int(lens.sum())), lens


def names(t: np.ndarray, length: int) -> np.ndarray:
    """Names of the runs of length tokens, one for each place (the last ones are void)."""
    have, out = 1, t
    while have < length:
        step = min(have, length - have)
        out = join64(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return np.concatenate((out, np.zeros(len(t) - len(out), np.uint64)))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width keys."""
    have, out = 1, keys
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def seeds(run: np.ndarray, lens: np.ndarray, spec: Spec) -> tuple[np.ndarray, ...]:
    """(text, start of text, seed, first and last window start) of every seed; places are in the whole batch."""
    ends = np.cumsum(lens)
    # starts of windows, text by text
    n = np.maximum(lens - spec.length + 1, 0)
    total = int(n.sum())
    none = np.empty(0, np.int64)
    if not total:
        return none, none, none, none, none
    text = np.repeat(np.arange(len(lens)), n)
    p = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends - lens, n)
    keys = (run & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(run), dtype=np.uint64)
    at = (_least(keys, spec.reach)[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]))))
    last = np.concatenate((new[1:], [total])) - 1
    return text[new], (ends - lens)[text[new]], at[new], p[new], p[last]


def pack(a, lo, hi):
    return a << 2 * BITS | (a - lo) << BITS | (a - hi)


def unpack(x):
    a = x >> 2 * BITS
    return a, a - (x >> BITS & FIELD), a - (x & FIELD)


def _fold(run: np.ndarray, at: list[np.ndarray], salt: int) -> np.ndarray:
    out = np.full(len(at[0]), np.uint64(salt))
    for i in at:
        out = join64(out, run[i])
    return out


def window_name(run: np.ndarray, p: np.ndarray, spec: Spec, salt: int) -> np.ndarray:
    return _fold(run, [p + min(j, spec.length - spec.seed) for j in range(0, spec.length, spec.seed)], salt)


def _flat(b, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    c = b.column(b.schema.get_field_index(column))
    n = c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return c.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(b.num_rows), n)


def _texts(b) -> list:
    return b.column(b.schema.get_field_index("text")).to_pylist()


def _tids(b) -> np.ndarray:
    return b.column(b.schema.get_field_index("tid")).to_numpy()


def survivors(ws: Workspace, texts: DataFrame, spec: Spec) -> DataFrame:
    """Rows (tid, places array<long>): the seeds whose name occurs again, packed with the window starts that they stand for."""

    def find(b):
        t, lens = tokens(_texts(b), spec.kind)
        run = names(t, spec.seed)
        text, base, a, lo, hi = seeds(run, lens, spec)
        return {"tid": _tids(b)[text], "place": pack(a - base, lo - base, hi - base), "name": run[a].view(np.int64)}

    found = ws.put(map_batches(texts.select("tid", "text"), find, "tid bigint, place bigint, name bigint", BATCH), "seeds")
    # counts are tables of their own: only then can Spark split the other side of the join at a hot name
    twice = ws.put(found.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"), "twice")
    level1 = ws.put(found.join(twice, "name", "left_semi").select("tid", "place"), "level1")
    ws.drop("seeds", "twice")
    ws.free()
    return level1.groupBy("tid").agg(F.collect_list("place").alias("places"))


def repeated(ws: Workspace, texts: DataFrame, spec: Spec) -> DataFrame:
    """Rows (tid, cover array<long>): windows starting in first..last repeat, packed as first << 32 | last."""
    grouped = survivors(ws, texts, spec)

    def extend(b):
        t, lens = tokens(_texts(b), spec.kind)
        run = names(t, spec.seed)
        place, row = _flat(b, "places")
        base = (np.cumsum(lens) - lens)[row]
        a, lo, hi = (x + base for x in unpack(place))
        end = hi + spec.length - spec.seed
        span = spec.length + spec.reach - 1
        ctx = _fold(run, [np.minimum(lo + j, end) for j in range(0, span, spec.seed)] + [end], 11)
        ctx = join64(ctx, (place & (1 << 2 * BITS) - 1).astype(np.uint64))
        double = join64(run[a], run[a + spec.seed])
        return {"tid": _tids(b)[row], "place": place, "name": double.view(np.int64), "ctx": ctx.view(np.int64)}

    more = ws.put(map_batches(texts.select("tid", "text").join(grouped, "tid"), extend, "tid bigint, place bigint, name bigint, ctx bigint", BATCH), "doubled")
    ws.drop("level1")
    ctx = more.groupBy("name", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tid", "place")).alias("one"))
    ctx = ws.put(ctx, "counted")
    groups = ctx.groupBy("name").agg(F.sum("n").alias("all"), F.max(F.col("n") == 1).alias("mixed"))
    ctx = ws.put(ctx.join(ws.put(groups.where("all > 1"), "groups"), "name"), "contexts")
    whole = more.join(ctx.where("n > 1").select("name", "ctx"), ["name", "ctx"], "left_semi").select("tid", "place")

    doubt = ws.put(ctx.where("mixed").select("one.tid", "one.place", (F.col("n") == 1).alias("alone")), "doubt")
    windows = doubtful(ws, texts, doubt, spec)
    again = ws.put(windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2"), "again")
    return covered(whole, windows.where("alone").join(again, ["w1", "w2"], "left_semi"))


def two_names(run: np.ndarray, p: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name the windows at p."""
    return window_name(run, p, spec, 23), window_name(run, p, spec, 37)


def doubtful(ws: Workspace, texts: DataFrame, doubt: DataFrame, spec: Spec, name: Callable = two_names) -> DataFrame:
    """doubt (tid, place, alone): single windows (tid, p, alone, w1, w2) of those runs, as far as the runs' extensions to either side repeat."""

    def single(b):
        t, lens = tokens(_texts(b), spec.kind)
        run = names(t, spec.seed)
        place, row = _flat(b, "places")
        alone, _ = _flat(b, "alone")
        base = (np.cumsum(lens) - lens)[row]
        _, lo, hi = unpack(place)
        n = hi - lo + 1
        p = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        g = p + np.repeat(base, n)
        w1, w2 = name(run, g, spec)
        return {"tid": np.repeat(_tids(b)[row], n), "p": p, "alone": np.repeat(alone.astype(bool), n), "w1": w1.view(np.int64), "w2": w2.view(np.int64)}

    def flank(b):
        t, lens = tokens(_texts(b), spec.kind)
        run = names(t, spec.seed)
        place, row = _flat(b, "places")
        end = np.cumsum(lens)[row]
        base = end - lens[row]
        a = unpack(place)[0] + base
        out = {k: [] for k in ("tid", "place", "side", "name")}
        for j in range(1, (spec.reach - 1) // spec.step + 1):
            e = j * spec.step
            for side, first, ok in ((j, a - e, a - e >= base), (-j, a, a + 2 * spec.seed + e <= end)):
                f = first[ok]
                last = f + e + spec.seed
                name = _fold(run, [np.minimum(f + k, last) for k in range(0, e + 2 * spec.seed, spec.seed)], 1000 + side)
                for k, v in zip(out, (_tids(b)[row[ok]], place[ok], np.full(len(f), side, np.int8), name.view(np.int64)), strict=True):
                    out[k].append(v)
        return {k: np.concatenate(v) for k, v in out.items()}

    near = doubt.groupBy("tid").agg(F.collect_list("place").alias("places"))
    flanks = ws.put(map_batches(texts.select("tid", "text").join(near, "tid"), flank, "tid bigint, place bigint, side tinyint, name bigint", BATCH), "flanks")
    shared = ws.put(flanks.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"), "shared")
    wide = flanks.join(shared, "name", "left_semi").groupBy("tid", "place").agg(F.max("side").alias("l"), F.min("side").alias("r"))
    step, most = spec.step, spec.reach - 1
    far = F.least(F.shiftright("place", BITS).bitwiseAND(FIELD), F.greatest(F.coalesce("l", F.lit(0)), F.lit(0)) * step + (step - 1))
    close = F.greatest(F.col("place").bitwiseAND(FIELD), most + F.least(F.coalesce("r", F.lit(0)), F.lit(0)) * step - (step - 1))
    doubt = doubt.join(wide, ["tid", "place"], "left").withColumns({"far": far, "close": close}).where("far >= close")
    doubt = doubt.select("tid", F.expr(f"shiftleft(shiftright(place, {2 * BITS}), {2 * BITS}) | shiftleft(far, {BITS}) | close").cast("long").alias("place"), "alone")
    listed = doubt.groupBy("tid").agg(F.collect_list(F.struct("place", "alone")).alias("x")).select("tid", F.col("x.place").alias("places"), F.col("x.alone").alias("alone"))
    return ws.put(map_batches(texts.select("tid", "text").join(listed, "tid"), single, "tid bigint, p bigint, alone boolean, w1 bigint, w2 bigint", BATCH), "windows")


def covered(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows (tid, cover) of whole runs (tid, place) and single windows (tid, p)."""
    a = F.shiftright("place", 2 * BITS)
    first, last = a - (F.shiftright("place", BITS).bitwiseAND(FIELD)), a - F.col("place").bitwiseAND(FIELD)
    cover = whole.select("tid", (F.shiftleft(first, 32).bitwiseOR(last)).alias("r")).unionByName(parts.select("tid", F.expr("shiftleft(p, 32) | p").alias("r")))
    return cover.groupBy("tid").agg(F.collect_list("r").alias("cover"))


def removed(cover: np.ndarray, n: int, copies: int, length: int) -> np.ndarray:
    """Mask of the tokens that repeated windows cover."""
    if copies > 1 and n >= length:
        return np.ones(n, bool)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, cover >> 32, 1)
    np.add.at(step, np.minimum((cover & 0xFFFFFFFF) + length, n), -1)
    return np.cumsum(step[:-1]) > 0


def sweep(docs: DataFrame, spec: Spec, render: Callable, schema: str, keep: tuple[str, ...] = ("doc_id",), tag: str = "repeats", find: Callable = repeated) -> DataFrame:
    """docs' kept columns with what render(text, mask) -> dict gives for each text; schema without the kept columns."""
    from methylake.llm.common import content_key, distinct_texts, packed, unpacked, with_tid

    ws = Workspace(docs.sparkSession, tag)
    texts = distinct_texts(ws, docs)
    cover = find(ws, texts, spec)

    def finish(b):
        out = []
        at = b.schema.get_field_index
        for text, copies, c in zip(_texts(b), b.column(at("copies")).to_pylist(), b.column(at("cover")), strict=True):
            n = len(split_words(text)) if spec.kind == "words" else len(text.encode("utf-8", "surrogatepass"))
            c = np.asarray(c.values.to_numpy() if c.is_valid else [], np.int64)
            out.append(render(text, removed(c, n, copies, spec.length)))
        return {"tid": b.column(at("tid"))} | {k: [x[k] for x in out] for k in out[0]}

    done = ws.put(map_batches(texts.join(cover, "tid", "left"), finish, f"tid bigint, {schema}", BATCH), "done")
    ws.drop_all_but("done", "apart")
    ws.free()
    keyed = with_tid(ws, docs.select(packed(keep).alias("keep"), content_key().alias("key")))
    return keyed.join(done, "tid").select(*unpacked("keep", keep), *[c for c in done.columns if c != "tid"])
