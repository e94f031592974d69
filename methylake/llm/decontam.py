"""Benchmark decontamination by latent semantic retrieval.

1. Terms are lower-cased words without punctuation; a term of the benchmark weighs its
   inverse document frequency, counted over all documents.
2. A randomised SVD of the benchmark's TF-IDF passages gives a vector to each term: tasks
   project their passages on random directions and return two small matrices whose sums
   fix the factors. (Passages of documents in the fit would spend the rank on directions
   that tell no item apart; all documents are indexed, and count for the weights.)
3. Every document is read as overlapping passages. A passage is a candidate for an item if
   the cosine of their latent vectors is high, the passage's length being at least its
   whole TF-IDF length times the share that the item keeps in latent space (words that the
   benchmark lacks count in it, with the median weight of the benchmark's words, so that
   the gate doesn't move with the number of documents).
4. The words around a candidate are compared with the item: the longest common subsequence
   must hold `share` of the item, or `low` of it with `share` of its answer (what follows a
   question mark or "answer:", else its last quarter).
5. Items that retrieval didn't find whole in a text are looked for by a bound that loses nothing:
   a common subsequence is no longer than the number of the item's words that the text has,
   so where these are enough, every window of the text that has enough of them (from the
   item's length before a word block to its length behind a passage) is compared as in 4.

The model is made of blocks of `block` items. Word counts are one pass over the documents,
the search is another, without a shuffle, whatever the number of blocks; models of more
than `MOST` bytes are searched in as many passes as they fill. Null and empty texts and
items match nothing. Repeated rows get equal rows. An item id counts once in a document:
several texts under one id (or repeated items) give the largest share among them. Ties
need no order: every item that passes is returned, by id. Extra columns stay out of the way.
Texts are read whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methylake.llm.common import map_batches, on_release

STEP, WIDE = 8, 4
#: Bytes of models that are broadcast for one pass, and items whose word counts are gathered at once.
MOST, COUNTED = 256 << 20, 100_000
_BLANK = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANK).split()


def answer_at(text: str, n: int) -> int:
    """Place of the answer's first word among the item's n words."""
    low = text.lower()
    cut = max(low.rfind("?"), low.rfind("answer:"))
    at = len(terms(low[:cut])) if cut >= 0 else n
    return at if 0 < at < n else n - max(1, n // 4)


@dataclass
class Model:
    vocab: dict[bytes, int]
    emb: np.ndarray  # terms + 1 (no term) x rank, weighed
    mass: np.ndarray  # squared weights, the last one for foreign words
    query: np.ndarray  # unit vectors of item passages
    kept: np.ndarray  # share of the item passage's length in latent space
    owner: np.ndarray  # item of each passage
    items: list[tuple[int, list[bytes], int]]  # id, words, place of the answer
    first: np.ndarray  # where each term's run in `holds` starts, and the end
    holds: np.ndarray  # items that hold the term, as often as they hold it
    nth: np.ndarray  # which occurrence in the item that is
    bags: list[tuple[np.ndarray, np.ndarray]]  # each item's terms, and how often it has them


@lru_cache(maxsize=4)
def _load(blob: bytes) -> Model:
    return pickle.loads(blob)


on_release(__name__, _load.cache_clear)


def lookup(texts: list, vocab: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    words = [terms(t) for t in texts]
    lens = np.fromiter(map(len, words), np.int64, len(words))
    idx = np.fromiter(map(vocab.get, chain.from_iterable(words), repeat(-1)), np.int64, int(lens.sum()))
    return idx, lens, words


def passages(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts of word blocks, text, first block and end block of each passage)."""
    nb = -(-lens // STEP)
    first = np.cumsum(nb) - nb
    starts = np.repeat(np.cumsum(lens) - lens, nb) + STEP * (np.arange(int(nb.sum())) - np.repeat(first, nb))
    n = np.where(nb > 0, np.maximum(nb - WIDE + 1, 1), 0)
    text = np.repeat(np.arange(len(lens)), n)
    lo = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return starts, text, lo, np.minimum(lo + WIDE, (first + nb)[text])


def frequencies(docs: DataFrame, vocab: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """Document frequency of each term and the number of documents, over all rows."""
    n = len(vocab)

    def count(b):
        idx, lens, _ = lookup(b.column(0).to_pylist(), vocab)
        text, known = np.repeat(np.arange(len(lens)), lens), idx >= 0
        term, times = np.unique(np.unique(text[known] * max(n, 1) + idx[known]) % max(n, 1), return_counts=True)
        return {"i": np.append(term, -1).astype(np.int32), "n": np.append(times, len(lens))}

    rows = map_batches(docs.select("text"), count, "i int, n bigint", 1 << 20).groupBy("i").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(n + 1)
    for r in rows:
        out[r["i"]] = r["n"]
    return out[:n], int(out[n])


def _tfidf(idx: np.ndarray, row: np.ndarray, rows: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows' unit TF-IDF vectors as (row, term, value), by row and term."""
    ok = idx >= 0
    key, times = np.unique(row[ok] * len(idf) + idx[ok], return_counts=True)
    r, t = key // len(idf), key % len(idf)
    value = times * idf[t]
    norm = np.sqrt(np.bincount(r, value**2, rows))
    return r, t, value / np.maximum(norm[r], 1e-9)


def _spread(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of values at their places."""
    out = np.zeros((size, values.shape[1]))
    if len(at):
        order = np.argsort(at, kind="stable")
        start = np.flatnonzero(np.append(True, np.diff(at[order]) > 0))
        out[at[order][start]] = np.add.reduceat(values[order], start, axis=0)
    return out


def factors(texts: DataFrame, vocab: dict[bytes, int], idf: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """Right singular vectors (terms x rank) of the passages' TF-IDF matrix A by a randomised range: Y = A O, G = Y'Y and Z = A'Y are summed over tasks."""
    wide = min(rank + 16, len(idf))

    def part(b):
        omega = np.random.default_rng(seed).standard_normal((len(idf), wide))
        idx, lens, _ = lookup(b.column(0).to_pylist(), vocab)
        size = STEP * WIDE
        n = -(-lens // size)
        row = np.repeat(np.cumsum(n) - n, lens) + (np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)) // size
        r, t, value = _tfidf(idx, row, int(n.sum()), idf)
        y = _spread(r, value[:, None] * omega[t], int(n.sum()))
        return {"g": [(y.T @ y).tobytes()], "z": [_spread(t, value[:, None] * y[r], len(idf)).astype(np.float32).tobytes()]}

    g, z = np.zeros((wide, wide)), np.zeros((len(idf), wide))
    for r in map_batches(texts.coalesce(4), part, "g binary, z binary", 1 << 20).toLocalIterator():
        g += np.frombuffer(r["g"]).reshape(wide, wide)
        z += np.frombuffer(r["z"], np.float32).reshape(len(idf), wide)
    w, u = np.linalg.eigh(g)
    ok = w > w.max() * 1e-10 if len(w) else w > 0
    b = (z @ (u[:, ok] / np.sqrt(w[ok]))).T  # Q'A
    s, v = np.linalg.eigh(b @ b.T)
    top = np.argsort(s)[::-1][: min(rank, int((s > s.max() * 1e-10).sum()))]
    return b.T @ (v[:, top] / np.sqrt(s[top]))


def fit(docs: DataFrame, benchmark: list[tuple[int, str]], rank: int = 64, seed: int = 5, counts: tuple | None = None) -> Model | None:
    """A block's model; counts: (vocabulary, document frequency of each term, documents) of a benchmark that holds the block, if known."""
    items = [(i, w, answer_at(t or "", len(w))) for i, t in benchmark if (w := terms(t))]
    if not items:
        return None
    vocab = {w: k for k, w in enumerate(sorted({w for _, ws, _ in items for w in ws}))}
    if counts is None:
        df, n = frequencies(docs, vocab)
    else:
        df, n = counts[1][[counts[0][w] for w in vocab]], counts[2]
    idf = np.log((n + 1) / (df + 0.5))
    spark = docs.sparkSession
    own = spark.createDataFrame([(t,) for _, t in benchmark if t], "text string")
    right = factors(own, vocab, idf, rank, seed)
    emb = np.vstack((right * idf[:, None], np.zeros(right.shape[1]))).astype(np.float32)
    mass = np.append(idf, np.median(idf)) ** 2
    queries, kept, owner = [], [], []
    for k, (_, ws, _) in enumerate(items):
        parts = max(1, round(len(ws) / (STEP * WIDE * 1.5)))
        for p in np.array_split(np.array([vocab[w] for w in ws]), parts):
            v = emb[p].sum(0)
            length = float(np.linalg.norm(v))
            if length > 0:
                queries.append(v / length), kept.append(length / np.sqrt(mass[p].sum())), owner.append(k)
    bags = [np.unique([vocab[w] for w in ws], return_counts=True) for _, ws, _ in items]
    times = np.concatenate([c for _, c in bags])
    term = np.repeat(np.concatenate([u for u, _ in bags]), times)
    item = np.repeat(np.arange(len(items), dtype=np.int32), [len(ws) for _, ws, _ in items])
    nth = 1 + np.arange(len(term)) - np.repeat(np.cumsum(times) - times, times)
    order = np.argsort(term, kind="stable")
    first = np.append(0, np.cumsum(np.bincount(term, minlength=len(vocab))))
    query = np.stack(queries) if queries else np.zeros((0, emb.shape[1]), np.float32)
    return Model(vocab, emb, mass.astype(np.float32), query, np.minimum(np.array(kept, np.float32), 1), np.array(owner, np.int64), items, first, item[order], nth[order], bags)


def lcs(item: list[bytes], words: list[bytes]) -> int:
    """Length of the longest common subsequence, a bit per item word."""
    where: dict[bytes, int] = {}
    for k, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in words:
        m = where.get(w)
        if m:
            x = row & m
            row = ((row + x) | (row - x)) & full
    return len(item) - row.bit_count()


def block_sums(emb: np.ndarray, idx: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sum of the words' vectors of each word block, word by word over all blocks at once; the last blocks are filled with no term, whose vector is zero."""
    nb = -(-lens // STEP)
    first = np.cumsum(nb) - nb
    full = np.full(int(nb.sum()) * STEP, -1)
    full[np.arange(len(idx)) + np.repeat(STEP * first - (np.cumsum(lens) - lens), lens)] = idx
    full = full.reshape(-1, STEP)
    out = emb[full[:, 0]]
    for j in range(1, STEP):
        out += emb[full[:, j]]
    return out


def near_latent(m: Model, idx: np.ndarray, lens: np.ndarray, cosine: float) -> dict[tuple[int, int], list[int]]:
    """(text, item) -> places of the passages that are near the item in latent space."""
    starts, text, lo, hi = passages(lens)
    spots: dict[tuple[int, int], list[int]] = {}
    if not len(starts) or not len(m.query):
        return spots
    sums = np.vstack((np.zeros(m.emb.shape[1], np.float32), block_sums(m.emb, idx, lens)))
    np.cumsum(sums, axis=0, out=sums)
    mass = np.concatenate(([0.0], np.cumsum(np.add.reduceat(m.mass[idx].astype(np.float64), starts))))
    x = sums[hi] - sums[lo]
    length = np.maximum(np.linalg.norm(x, axis=1), 1e-9)
    whole = np.sqrt(mass[hi] - mass[lo]).astype(np.float32)
    near = x @ m.query.T
    maybe = np.flatnonzero(near.max(1) >= cosine * np.maximum(length, whole * m.kept.min()))
    if not len(maybe):
        return spots
    ok = near[maybe] >= cosine * np.maximum(length[maybe, None], whole[maybe, None] * m.kept[None, :])
    begin = np.cumsum(lens) - lens
    for a, q in zip(*np.nonzero(ok), strict=True):
        p = maybe[a]
        spots.setdefault((int(text[p]), int(m.owner[q])), []).append(int(starts[lo[p]] - begin[text[p]]))
    return spots


def enough_words(m: Model, idx: np.ndarray, lens: np.ndarray, least: float, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts, segments, items) where a segment has words for `least` of the item. Segments are two spans long and start at each, so every window of a span is in the one where it starts."""
    n, q = len(m.vocab), len(m.items)
    cells = -(-lens // span)
    text, first = np.repeat(np.arange(len(lens)), cells), np.cumsum(cells) - cells
    seg = (np.arange(len(idx)) - np.repeat(np.cumsum(lens) - lens, lens)) // span
    row = np.repeat(first, lens) + seg
    known = idx >= 0
    both = known & (seg > 0)
    key, times = np.unique(np.append((row * n + idx)[known], ((row - 1) * n + idx)[both]), return_counts=True)
    row, term = key // n, key % n
    size = m.first[term + 1] - m.first[term]
    at = np.repeat(m.first[term] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    ok = m.nth[at] <= np.repeat(times, size)
    has = np.bincount((np.repeat(row, size) * q + m.holds[at])[ok], minlength=len(text) * q).reshape(len(text), q)
    row, item = np.nonzero(has >= least * np.array([len(ws) for _, ws, _ in m.items]) - 1e-9)
    return text[row], row - first[text[row]], item


def windows(own: np.ndarray, code: np.ndarray, times: np.ndarray, at: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Of the windows around the word blocks that start at `at`, those that have words for `least` of an item, as ranges of own; equal ones once.

    own, code: places and numbers of the text's words that the item has; times: how often
    the item has each. A repeated word counts as often as the item has it, at most.
    """
    size = int(times.sum())
    need = least * size - 1e-9
    lo, hi = np.searchsorted(own, at - size), np.searchsorted(own, at + STEP * WIDE + size)
    ok = hi - lo >= need
    lo, hi = lo[ok], hi[ok]
    if not len(lo):
        return []
    counts = np.zeros((len(own) + 1, len(times)), np.int32)
    counts[np.arange(1, len(counts)), code] = 1
    np.cumsum(counts, axis=0, out=counts)
    ok = np.minimum(counts[hi] - counts[lo], times).sum(1) >= need
    return sorted(set(zip(lo[ok].tolist(), hi[ok].tolist(), strict=True)))


def find(m: Model, texts: list, cosine: float, share: float, low: float) -> list[dict[int, float]]:
    """For each text the items found in it, with the share of their words."""
    idx, lens, words = lookup(texts, m.vocab)
    out: list[dict[int, float]] = [{} for _ in texts]
    if not len(idx):
        return out

    def compare(t: int, k: int, near: list) -> None:
        name, item, cut = m.items[k]
        n = lcs(item, near) / len(item)
        if n >= share or n >= low and lcs(item[cut:], near) >= share * (len(item) - cut):
            out[t][name] = max(n, out[t].get(name, 0.0))

    for (t, k), places in near_latent(m, idx, lens, cosine).items():
        size, end = len(m.items[k][1]), -1
        for at in sorted(set(places)):
            if at + STEP * WIDE <= end:
                continue
            first, end = max(0, at - size), at + STEP * WIDE + size
            compare(t, k, words[t][first:end])
    begin = np.cumsum(lens) - lens
    least = min(share, low)
    number = np.full(len(m.vocab) + 1, -1)
    span = STEP * WIDE + 2 * max(len(ws) for _, ws, _ in m.items)
    span += -span % STEP
    for t, j, k in zip(*map(np.ndarray.tolist, enough_words(m, idx, lens, least, span)), strict=True):
        name, item, _ = m.items[k]
        if out[t].get(name, 0.0) >= 1:
            continue
        ids, times = m.bags[k]
        number[ids] = np.arange(len(ids))
        start, stop = j * span, min((j + 2) * span, int(lens[t]))
        code = number[idx[begin[t] + start : begin[t] + stop]]
        number[ids] = -1
        own = np.flatnonzero(code >= 0)
        # the windows that start in the segment's first half; the text's first ones are cut by its start
        at = np.arange(start + len(item) + -len(item) % STEP if j else 0, min(start + span + len(item), int(lens[t])), STEP)
        spans = windows(own, code[own], times, at - start, least)
        if spans:
            near = [words[t][start + p] for p in own.tolist()]
            for lo, hi in spans:
                compare(t, k, near[lo:hi])
    return out


def models(docs: DataFrame, benchmark: DataFrame, block: int) -> Iterator[Model]:
    """The blocks' models; the documents are counted once for `COUNTED` items."""
    for part in _blocks(benchmark, max(block, COUNTED)):
        vocab = {w: k for k, w in enumerate(sorted({w for _, t in part for w in terms(t)}))}
        counts = (vocab, *frequencies(docs, vocab)) if vocab else None
        for i in range(0, len(part), block):
            model = fit(docs, part[i : i + block], counts=counts)
            if model is not None:
                yield model


def scan(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), cosine: float = 0.4, share: float = 0.8, low: float = 0.6, block: int = 2000) -> DataFrame:
    """Kept columns, text, items array<long> and shares array<double>: the benchmark items that each document holds."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = "".join(f"`{k}` {types[k]}, " for k in keep) + "text string, items array<bigint>, shares array<double>"
    out = docs.select(*keep, "text", F.expr("cast(array() as array<bigint>)").alias("items"), F.expr("cast(array() as array<double>)").alias("shares"))

    def search(out: DataFrame, blobs: list[bytes]) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(blobs)

        def run(b):
            at = b.schema.get_field_index
            texts = b.column(at("text")).to_pylist()
            found = [dict(zip(i, s, strict=True)) for i, s in zip(b.column(at("items")).to_pylist(), b.column(at("shares")).to_pylist(), strict=True)]
            for blob in held.value:
                for own, more in zip(found, find(_load(blob), texts, cosine, share, low), strict=True):
                    own.update({i: max(x, own.get(i, 0.0)) for i, x in more.items()})
            return {k: b.column(at(k)) for k in (*keep, "text")} | {"items": [sorted(f) for f in found], "shares": [[f[i] for i in sorted(f)] for f in found]}

        return map_batches(out, run, schema, 1 << 18)

    blobs: list[bytes] = []
    for model in models(docs, benchmark, block):
        blob = pickle.dumps(model)
        if blobs and sum(map(len, blobs)) + len(blob) > MOST:
            out, blobs = search(out, blobs), []
        blobs.append(blob)
    return search(out, blobs) if blobs else out


def _blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple[int, str]]]:
    """Different items of the benchmark with an id, at most `block` at a time."""
    part: list[tuple[int, str]] = []
    for r in benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        part.append((r[0], r[1]))
        if len(part) == block:
            yield part
            part = []
    if part:
        yield part
