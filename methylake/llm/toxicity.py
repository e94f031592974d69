"""Toxicity by compression distance.

Texts are lower-cased and every run of other bytes than letters becomes one blank. Two
zstandard dictionaries are trained (`zstandard.train_dictionary`) on text windows of two
thirds of the sample: the ordinary one on windows from all over ordinary texts, the toxic
one on the stretches of toxic texts made of 6-byte strings that are significantly more
frequent there (capped counts per text; the lower bound of the log ratio decides, an
absolute test, so no string is measured against the commonest). A stretch can be a word, a
part of one, or run over several, so a stem is learnt whatever its endings.

Overlapping windows of two lengths are compressed with the ordinary dictionary, and with
the toxic one put behind it; what the second saves is the window's gain. A text's
features are, for each length, the density of its gains and its three largest. A logistic
model of them is fitted on the other third, and the threshold is calibrated so that
three in 400 ordinary texts there pass; it lies at score 0.7. A window that shares none of the
telling 6-byte strings with the toxic dictionary counts as no gain and is not compressed.

Null and empty texts have no window and get the score of a text without any gain. Without
both labels in training, or if nothing sets toxic texts apart, every score is 0. Copies
count once in training; of copies with different labels the larger one holds. Repeated
rows get equal rows, ties equal scores. Extra columns are ignored. Every text is read
whole. The fit uses a sample of about `max_rows` labelled rows.
"""

from __future__ import annotations

import math
import random
import zlib
from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methylake.llm.common import Workspace, content_key, map_batches, on_release

#: Labelled rows at most in the fit (by a hash of the id), the documented bound.
MAX_ROWS = 20_000
#: Bounds of what is collected from that sample: different stretches, and windows of each ordinary text.
STRETCHES, PIECES = 20_000, 4
CALIBRATED, PASS = 0.7, 0.0075
GRAM = 6
#: Window length, step, and the shortest match that counts in it.
WINDOWS = ((24, 16, 6), (96, 64, 7))
_BLANK = bytes(b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def bare(text: str | None) -> bytes:
    """Letters of a text with one blank between words and at both ends; nothing if it has none."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANK).split()
    return b" " + b" ".join(words) + b" " if words else b""


def grams(data: bytes) -> np.ndarray:
    """The 6-byte strings at all places, as numbers."""
    b = np.frombuffer(data, np.uint8)
    n = max(len(b) - GRAM + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = out << np.uint64(8) | b[k : k + n]
    return out


class Wanted:
    """Tells which codes are among the wanted ones: a hashed table first, then the exact test for what it lets through."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.unique(codes)
        self.shift = np.uint64(64 - max(16, len(self.codes).bit_length() + 4))
        self.table = np.zeros(1 << int(64 - self.shift), bool)
        self.table[self._slot(self.codes)] = True

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Where the wanted codes are."""
        at = np.flatnonzero(self.table[self._slot(codes)])
        if not len(at):
            return at
        found = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        return at[self.codes[found] == codes[at]]


@lru_cache(maxsize=2)
def wanted(codes: bytes) -> Wanted:
    return Wanted(np.frombuffer(codes, np.uint64))


class Pair:
    """Compressors with the ordinary dictionary, and with the toxic one behind it, for each kind of window."""

    def __init__(self, plain: bytes, toxic: bytes, marks: bytes):
        self.own = Wanted(np.intersect1d(grams(toxic), np.frombuffer(marks, np.uint64)))
        self.kinds = [(*kind, self._make(plain, kind[2]), self._make(plain + toxic, kind[2])) for kind in WINDOWS]

    @staticmethod
    def _make(data: bytes, shortest: int):
        # fast strategy with a target length: literals stay as they are, so a saved byte shows in the length
        params = zstandard.ZstdCompressionParameters(window_log=17, chain_log=14, hash_log=16, search_log=1, min_match=shortest, target_length=1, strategy=zstandard.STRATEGY_FAST, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text: density of the gains and the largest three, for each kind of window."""
        raw = [bare(t) for t in texts]
        begin = np.concatenate(([0], np.cumsum([len(x) + 1 for x in raw])))
        data = b"\x00".join(raw)
        place = self.own.places(grams(data))
        text = np.searchsorted(begin, place, "right") - 1
        place = place - begin[text]
        out = np.zeros((len(texts), 2 * len(self.kinds)))
        for k, (size, step, _, plain, both) in enumerate(self.kinds):
            first = np.maximum(-((size - GRAM - place) // step), 0)
            some = [np.stack((text, w), 1)[w <= place // step] for j in range(size // step + 1) for w in (first + j,)]
            gains: dict[int, list[int]] = {}
            for t, w in np.unique(np.concatenate(some), axis=0).tolist():
                x = raw[t][w * step : w * step + size]
                gains.setdefault(t, []).append(len(plain(x)) - len(both(x)))
            for t, g in gains.items():
                out[t, 2 * k] = math.log1p(100 * sum(x for x in g if x > 1) / (len(raw[t]) / step + 4))
                out[t, 2 * k + 1] = math.log1p(max(0, sum(sorted(g)[-3:])))
        return out


@lru_cache(maxsize=2)
def pair(plain: bytes, toxic: bytes, marks: bytes) -> Pair:
    return Pair(plain, toxic, marks)


def _clear() -> None:
    pair.cache_clear()
    wanted.cache_clear()


on_release(__name__, _clear)


def with_features(texts: DataFrame, model: dict, keep: tuple[str, ...]) -> DataFrame:
    parts = model["plain"], model["toxic"], model["marks"]
    types = {f.name: f.dataType.simpleString() for f in texts.schema}

    def run(b):
        return {k: b.column(i) for i, k in enumerate(keep)} | {"features": pair(*parts).features(b.column(len(keep)).to_pylist()).tolist()}

    return map_batches(texts.select(*keep, "text"), run, "".join(f"`{k}` {types[k]}, " for k in keep) + "features array<double>", 1 << 20)


def counted(texts: DataFrame, only: np.ndarray | None, least: int = 1, cap: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """6-byte strings (all or some only) and how often they occur, `cap` times in a text at most, `least` times in all at least."""
    raw = None if only is None else only.tobytes()

    def run(b):
        codes, times = [], []
        for t in b.column(0).to_pylist():
            c = grams(bare(t))
            c, n = np.unique(c if raw is None else c[wanted(raw).places(c)], return_counts=True)
            codes.append(c), times.append(np.minimum(n, cap))
        c, at = np.unique(np.concatenate(codes), return_inverse=True)
        return {"code": c.view(np.int64), "n": np.bincount(at, np.concatenate(times), len(c)).astype(np.int64)}

    got = map_batches(texts.select("text"), run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
    codes, n = got["code"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.float64)
    order = np.argsort(codes)
    return codes[order], n[order]


def telling(toxic: DataFrame, ordinary: DataFrame, n1: int, n0: int, least: int = 8, ratio: float = 3.0, deviations: float = 3.0) -> np.ndarray:
    """6-byte strings whose share in toxic texts is `ratio` times that in ordinary ones, at the lower bound of the log ratio."""
    codes, a = counted(toxic, None, least)
    if not len(codes):
        return codes
    found, n = counted(ordinary, codes)
    b = np.zeros(len(codes))
    b[np.searchsorted(codes, found)] = n
    low = np.log((a + 0.5) / n1) - np.log((b + 0.5) / n0) - deviations * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    return codes[low > math.log(ratio)]


def stretches(texts: DataFrame, only: np.ndarray) -> list[bytes]:
    """The runs of wanted strings with a byte on either side, the commonest first, as often as they occur (50 times at most)."""
    raw = only.tobytes()

    def run(b):
        out = []
        for t in b.column(0).to_pylist():
            x = bare(t)
            hit = wanted(raw).places(grams(x))
            if len(hit):
                cut = np.flatnonzero(np.diff(hit) > GRAM)
                out += [x[max(0, lo - 1) : hi + GRAM + 1] for lo, hi in zip(hit[np.append(0, cut + 1)].tolist(), hit[np.append(cut, len(hit) - 1)].tolist(), strict=True)]
        return {"piece": out}

    pieces = map_batches(texts.select("text"), run, "piece binary").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    return [bytes(r["piece"]) for r in pieces.orderBy(F.desc("n"), "piece").limit(STRETCHES).collect() for _ in range(min(r["n"], 50))]


def anywhere(texts: DataFrame, size: int = 18) -> list[bytes]:
    """A few windows from random places of each text, in random order."""

    def run(b):
        out = []
        for t in b.column(0).to_pylist():
            x = bare(t)
            rng = random.Random(zlib.crc32(x))
            out += [x[i : i + size] for i in (rng.randrange(max(1, len(x) - size + 1)) for _ in range(PIECES if x else 0))]
        return {"piece": out}

    return sorted((bytes(r["piece"]) for r in map_batches(texts.select("text"), run, "piece binary").collect()), key=lambda x: (zlib.crc32(x), x))


def trained(windows: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of the windows; where they are too few to train one, the windows themselves."""
    try:
        return zstandard.train_dictionary(size, windows, k=16, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(reversed(dict.fromkeys(windows)))[-size:]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights and, last, the constant, by Newton's method."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    keep = np.diag(np.append(np.full(len(w) - 1, ridge), 1e-6))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
    return w


def fit(rows: DataFrame, plain_size: int = 16_000, toxic_size: int = 2048) -> dict | None:
    """rows (text, toxic 0/1), a bounded sample -> model for score()."""
    ws = Workspace(rows.sparkSession, "toxicity")
    d = rows.where("text is not null and toxic is not null").withColumn("key", content_key()).groupBy("key").agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    d = ws.put(d.select("toxic", "text", (F.pmod(F.xxhash64("key"), F.lit(3)) == 0).alias("aside")), "sample")
    sizes = {(r["toxic"], r["aside"]): r["n"] for r in d.groupBy("toxic", "aside").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not all(sizes.get((label, part)) for label in (0, 1) for part in (True, False)):
        return None
    toxic, ordinary = d.where("toxic = 1 and not aside"), d.where("toxic = 0 and not aside")
    marks = telling(toxic, ordinary, sizes[1, False], sizes[0, False])
    if not len(marks):
        return None
    model = {"plain": trained(anywhere(ordinary), plain_size), "toxic": trained(stretches(toxic, marks), toxic_size), "marks": marks.tobytes()}
    told = with_features(d.where("aside"), model, ("toxic",)).toPandas()
    x, y = np.array(told["features"].tolist()), told["toxic"].to_numpy(np.float64)
    w = logistic(x, y)
    z = x @ w[:-1] + w[-1]
    ws.drop("sample")
    return model | {"weights": [float(v) for v in w[:-1]], "cut": float(np.quantile(z[y == 0], 1 - PASS) - w[-1]) + 1e-9}


def score(docs: DataFrame, model: dict | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns with level (the weighed features less the calibrated threshold), score and predicted."""
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("level"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    level = F.lit(-model["cut"])
    for i, w in enumerate(model["weights"]):
        level = level + F.col("features")[i] * w
    out = with_features(docs, model, keep).select(*keep, level.alias("level"))
    out = out.withColumn("score", 1 / (1 + F.exp(-(F.col("level") + math.log(CALIBRATED / (1 - CALIBRATED))))))
    return out.withColumn("predicted", (F.col("score") >= CALIBRATED).cast("int"))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, toxic) of max_rows labelled documents or a little more, by a hash of their id; labels are broadcast, their number being bounded."""
    n = labels.count()
    few = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 48)) < math.ceil(min(1.0, max_rows / max(n, 1)) * (1 << 48)))
    few = few.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "toxic")


def auc(scores: np.ndarray, truth: np.ndarray) -> float:
    """Area under the ROC curve, ties half."""
    kinds, at = np.unique(scores, return_inverse=True)
    pos, neg = np.bincount(at[truth == 1], minlength=len(kinds)), np.bincount(at[truth == 0], minlength=len(kinds))
    below = np.cumsum(neg) - neg
    return float((pos * (below + neg / 2)).sum() / max(pos.sum() * neg.sum(), 1))
