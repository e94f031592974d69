"""Language ID by hyperdimensional profiles.

Each letter has a random bipolar vector, drawn from a seed and its code point. A trigram
abc is bound as rho^2(a) * rho(b) * c, rho a cyclic shift; a text is the bundle (sum) of
its trigrams, a language the bundle of its training texts. A text gets the language of
the highest cosine; the cosine, cut to 0..1, is its score.

Case is folded and every run of other characters than letters counts as one blank, so a
word's edges take part. Texts that are null or hold no letter get ``und`` and score 0.
Ties go to the first language by name. Extra columns are ignored. Training needs at
least one row with a language; without any, every text is ``und``. Copies count once in
training, and repeated rows get equal rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methylake.llm.common import map_batches, mix64, on_release

DIM = 1024
#: Training rows at most (taken by a hash of the text), the documented bound of the fit.
TRAIN_ROWS = 20_000


@lru_cache(maxsize=100_000)
def letter(code: int, dim: int, seed: int) -> np.ndarray:
    bits = mix64(np.arange(dim // 64, dtype=np.uint64) + np.uint64((code + 1) * 1_000_003 + seed))
    return np.unpackbits(bits.view(np.uint8)).astype(np.int8) * 2 - 1


on_release(__name__, letter.cache_clear)


def trigram_vectors(codes: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Rows of +-1 for trigram codes (three 21-bit code points)."""
    parts = [(codes >> np.uint64(s)) & np.uint64(0x1FFFFF) for s in (42, 21, 0)]
    out = np.ones((len(codes), dim), np.int8)
    for turn, part in zip((2, 1, 0), parts, strict=True):
        kinds, at = np.unique(part, return_inverse=True)
        table = np.stack([np.roll(letter(int(k), dim, seed), turn) for k in kinds])
        out *= table[at]
    return out


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigram_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, trigram code) of every trigram; blanks count as letter 0."""
    joined = "\x00" + "\x00".join(t or "" for t in texts) + "\x00"
    low = joined.lower()
    if len(low) != len(joined):  # a few characters change their length: fold them singly
        low = "".join(c if len(x := c.lower()) != 1 else x for c in joined)
    cp = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts), dtype=np.int32), lens)
    row = np.concatenate(([np.int32(0)], row))
    ok = _letters()[cp]
    keep = ok | np.concatenate(([True], ok[:-1]))  # the first of a run of others
    cp, row, ok = cp[keep], row[keep], ok[keep]
    c = np.where(ok, cp, 0).astype(np.uint64)
    if len(c) < 3:
        return np.empty(0, np.int32), np.empty(0, np.uint64)
    code = c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]
    mid = ok[1:-1]  # a blank in the middle would join two words
    return row[1:-1][mid], code[mid]


def bundles(texts: list[str | None], dim: int, seed: int) -> np.ndarray:
    """A row for each text: the sum of its trigram vectors."""
    row, code = trigram_codes(texts)
    kinds, at = np.unique(code, return_inverse=True)
    out = np.zeros((len(texts), dim), np.float32)
    step = 8192
    for lo in range(0, len(kinds), step):
        own = (at >= lo) & (at < lo + step)
        n = min(step, len(kinds) - lo)
        counts = np.bincount(row[own].astype(np.int64) * n + (at[own] - lo), minlength=len(texts) * n).reshape(len(texts), n)
        out += counts.astype(np.float32) @ trigram_vectors(kinds[lo : lo + n], dim, seed).astype(np.float32)
    return out


def share(most: int, n: int, bits: int = 60) -> int:
    """Hashes of so many bits below this make about `most` of n rows; at least one hash, whatever n."""
    return max(1, -(-(most << bits) // n))


def train(docs: DataFrame, dim: int = DIM, seed: int = 7, max_rows: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """Prototypes by language from rows with text and lang. Only languages x dim sums come to the driver."""
    rows = docs.where("text is not null and lang is not null")
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 60)) < share(max_rows, n))
    rows = rows.select("text", "lang").distinct()  # a text that all its copies bring along counts once

    def run(b):
        texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
        v = bundles(texts, dim, seed)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1)  # long texts weigh no more than short ones
        names = sorted(set(langs))
        return {"lang": names, "vec": [v[[i for i, x in enumerate(langs) if x == k]].astype(np.float64).sum(0).tolist() for k in names]}

    parts = map_batches(rows.select("text", "lang"), run, "lang string, vec array<double>", 1 << 20)
    sums = parts.select("lang", F.posexplode("vec").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    got = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v")).collect()
    return {r["lang"]: np.array(r["v"]) for r in sorted(got, key=lambda r: r["lang"])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",), dim: int = DIM, seed: int = 7) -> DataFrame:
    """Kept columns with lang_pred, score and margin (to the second language)."""
    names = sorted(prototypes)
    protos = np.stack([prototypes[k] / max(np.linalg.norm(prototypes[k]), 1e-9) for k in names]).astype(np.float32) if names else np.zeros((0, dim), np.float32)
    types = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(b):
        v = bundles(b.column(b.num_columns - 1).to_pylist(), dim, seed)
        norm = np.linalg.norm(v, axis=1)
        lang, score, margin = [], [], []
        cos = v @ protos.T / np.maximum(norm, 1e-9)[:, None]
        for c, m in zip(cos, norm, strict=True):
            if m == 0 or not names:
                lang.append("und"), score.append(0.0), margin.append(0.0)
                continue
            best = int(np.argmax(c))
            rest = np.delete(c, best)
            lang.append(names[best])
            score.append(min(1.0, max(0.0, float(c[best]))))
            margin.append(float(c[best] - rest.max()) if len(rest) else 1.0)
        return {k: b.column(i) for i, k in enumerate(keep)} | {"lang_pred": lang, "score": score, "margin": margin}

    return map_batches(docs.select(*keep, "text"), run, ", ".join(f"`{k}` {types[k]}" for k in keep) + ", lang_pred string, score double, margin double", 1 << 20)
