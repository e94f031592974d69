"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves hold, for each adjacent pair of symbols, rank * 2^k + position; the root is
their minimum, that is the leftmost pair of the lowest rank. A merge changes three
leaves (the pair, its left and its right neighbour) and the paths above them; it ends
when the root says that no pair can be merged. Short pieces of one batch are merged
together, a tree per row of a matrix; long pieces get a tree of their own.

Null texts count as empty; an empty text has no ids and decodes to an empty text.
Tokens are those of the vocabulary file, special strings included. Extra columns are
ignored. Every text is read whole; each input row gives one output row.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from methylake.llm.common import map_batches, on_release

#: Fixed value: the published split pattern of byte-level BPE.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
INF = np.int64(2**62)
LONG = 256
CACHE = 120_000


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte value: visible Latin-1 bytes stand for themselves, the rest are moved above 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one tokenizers file (byte-level BPE)."""

    def __init__(self, path: str, cache: int = CACHE):
        self.most = cache
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        alpha = byte_alphabet()
        back = {c: b for b, c in alpha.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes = {i: bytes(back[c] for c in s) if all(c in back for c in s) else s.encode() for s, i in vocab.items()}
        self.token_bytes |= {i: s.encode() for s, i in self.special.items()}
        self.first = np.array([vocab[alpha[b]] for b in range(256)], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.pair_rank = dict(zip(keys.tolist(), range(len(pairs)), strict=True))
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.gap = regex.compile(r"\s\s")
        self.cache: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}
        self.pieces: dict[str, tuple[str, bytes]] = {}

    # --- merging -------------------------------------------------------------

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a << 32 | b
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where((self.keys[i] == k) & (a >= 0) & (b >= 0), self.ranks[i], -1)

    def merge_rows(self, rows: list[bytes]) -> list[list[int]]:
        """Encodes pieces of 2..LONG bytes, grouped by tree size."""
        out: list[list[int]] = [None] * len(rows)  # type: ignore[list-item]
        groups: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            groups.setdefault(max(2, 1 << (len(r) - 2).bit_length()), []).append(i)
        for leaves, idx in groups.items():
            for at in range(0, len(idx), 1 << 15):
                part = idx[at : at + (1 << 15)]
                for i, ids in zip(part, self._merge_matrix([rows[i] for i in part], leaves), strict=True):
                    out[i] = ids
        return out

    def _merge_matrix(self, rows: list[bytes], leaves: int) -> list[list[int]]:
        n, width, shift = len(rows), leaves + 1, leaves.bit_length()
        lens = np.fromiter(map(len, rows), np.int64, n)
        sym = np.full((n, width + 1), -1, np.int64)
        fill = np.arange(width + 1) < lens[:, None]
        sym[fill] = self.first[np.frombuffer(b"".join(rows), np.uint8)]
        nxt = np.tile(np.arange(1, width + 2), (n, 1))
        prv = np.tile(np.arange(-1, width), (n, 1))
        rank = self.rank_of(sym[:, :leaves], sym[:, 1:width])
        tree = np.full((n, 2 * leaves), INF)
        tree[:, leaves:] = np.where(rank >= 0, rank << shift | np.arange(leaves), INF)
        for v in range(leaves - 1, 0, -1):
            tree[:, v] = np.minimum(tree[:, 2 * v], tree[:, 2 * v + 1])
        live = np.flatnonzero(tree[:, 1] < INF)
        while len(live):
            root = tree[live, 1]
            pos, new = root & ((1 << shift) - 1), self.merged[root >> shift]
            gone = nxt[live, pos]
            after = nxt[live, gone]
            sym[live, pos], sym[live, gone] = new, -1
            nxt[live, pos] = after
            prv[live, np.minimum(after, width)] = pos
            before = prv[live, pos]
            r = self.rank_of(new, sym[live, np.minimum(after, width)])
            l = self.rank_of(np.where(before >= 0, sym[live, before], -1), new)
            self._point(tree, live, gone, np.full(len(live), INF), leaves)
            self._point(tree, live, pos, np.where(r >= 0, r << shift | pos, INF), leaves)
            self._point(tree, live, before, np.where(l >= 0, l << shift | before, INF), leaves)
            live = live[tree[live, 1] < INF]
        flat, ends = sym[sym >= 0].tolist(), np.cumsum((sym >= 0).sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def _point(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, leaves: int) -> None:
        """Sets one leaf per row and repairs the path to the root; leaves out of range are left alone."""
        ok = (leaf >= 0) & (leaf < leaves)
        rows, v = rows[ok], leaf[ok] + leaves
        tree[rows, v] = value[ok]
        while leaves > 1:
            v >>= 1
            tree[rows, v] = np.minimum(tree[rows, 2 * v], tree[rows, 2 * v + 1])
            leaves >>= 1

    def merge_long(self, piece: bytes) -> list[int]:
        """One tree for a piece of any length: O(n log n)."""
        sym = self.first[np.frombuffer(piece, np.uint8)].tolist()
        n = len(sym)
        if n < 2:
            return sym
        leaves = 1 << (n - 2).bit_length() if n > 2 else 1
        shift, rank, big, merged = n.bit_length(), self.pair_rank, int(INF), self.merged.tolist()
        tree = [big] * (2 * leaves)
        for i in range(n - 1):
            r = rank.get(sym[i] << 32 | sym[i + 1], -1)
            if r >= 0:
                tree[leaves + i] = r << shift | i
        for v in range(leaves - 1, 0, -1):
            tree[v] = min(tree[2 * v], tree[2 * v + 1])
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

        def point(i: int, value: int) -> None:
            v = i + leaves
            tree[v] = value
            v >>= 1
            while v:
                low = min(tree[2 * v], tree[2 * v + 1])
                if tree[v] == low:
                    break
                tree[v] = low
                v >>= 1

        while tree[1] < big:
            i = tree[1] & ((1 << shift) - 1)
            j = nxt[i]
            sym[i], sym[j] = merged[tree[1] >> shift], -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
            if j < n - 1:
                point(j, big)
            r = rank.get(sym[i] << 32 | sym[k], -1) if k < n else -1
            point(i, r << shift | i if r >= 0 else big)
            h = prv[i]
            if h >= 0:
                r = rank.get(sym[h] << 32 | sym[i], -1)
                point(h, r << shift | h if r >= 0 else big)
        return [s for s in sym if s >= 0]

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        short = [i for i, p in enumerate(pieces) if 2 <= len(p) <= LONG]
        done = dict(zip(short, self.merge_rows([pieces[i] for i in short]), strict=True))
        return [done[i] if i in done else self.merge_long(p) for i, p in enumerate(pieces)]

    # --- texts ---------------------------------------------------------------

    def chunks(self, text: str) -> list[str]:
        """Cuts a text where no piece of the pattern can cross: before single spaces. Special strings stand alone."""
        out: list[str] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if not part:
                continue
            if part in self.special:
                out.append(part)
            elif self.gap.search(part):
                out += self.split.findall(part)
            else:
                words = part.split(" ")
                tail = [" " + w for w in words[1:]]
                out += ([words[0]] if words[0] else []) + tail
        return out

    def fill(self, wanted: set[str]) -> None:
        """Encodes the chunks that neither generation of the cache has."""
        if len(self.cache) > self.most:
            self.older, self.cache = self.cache, {}
        if len(self.pieces) > 2 * self.most:
            self.pieces.clear()
        new = []
        for c in wanted:
            if c in self.cache:
                continue
            if (got := self.older.get(c)) is None:
                new.append(c)
            else:
                self.cache[c] = got
        find, known = self.split.findall, self.pieces
        plan = [None if c in self.special else find(c) for c in new]
        fresh = list({p for own in plan if own for p in own if p not in known})
        token = self.token_bytes.__getitem__
        for p, ids in zip(fresh, self.merge([p.encode("utf-8", "surrogatepass") for p in fresh]), strict=True):
            known[p] = ",".join(map(str, ids)), b"".join(map(token, ids))
        for c, own in zip(new, plan, strict=True):
            if own is None:
                self.cache[c] = str(self.special[c]), token(self.special[c])
            elif len(own) == 1:
                self.cache[c] = known[own[0]]
            else:
                parts = [known[p] for p in own]
                self.cache[c] = ",".join([x[0] for x in parts]), b"".join([x[1] for x in parts])

    def encode(self, text: str | None) -> list[int]:
        c = self.chunks(text or "")
        self.fill(set(c))
        return [int(t) for x in c for t in self.cache[x][0].split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.token_bytes[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def codec(path: str, cache: int = CACHE) -> Codec:
    return Codec(path, cache)


on_release(__name__, codec.cache_clear)


def encode_table(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs with ids array<int> and decoded string beside the kept columns."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(b):
        c = codec(path, CACHE // 4)  # beside the ids there is less room
        split = [c.chunks(t or "") for t in b.column(b.schema.get_field_index("text")).to_pylist()]
        c.fill({x for s in split for x in s})
        got = [[c.cache[x] for x in s] for s in split]
        flat = [np.fromstring(",".join([g[0] for g in s]), np.int32, sep=",") if s else np.empty(0, np.int32) for s in got]
        ends = np.cumsum([0, *map(len, flat)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat)))
        return {k: b.column(b.schema.get_field_index(k)) for k in keep} | {"ids": ids, "decoded": [b"".join([g[1] for g in s]).decode("utf-8", "replace") for s in got]}

    return map_batches(docs.select(*keep, "text"), run, ", ".join(f"`{k}` {types[k]}" for k in keep) + ", ids array<int>, decoded string", 2 << 20)


def digest_table(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' kept columns with n_tokens, ids_sha256 and decoded_sha256: the digests of ids and decoded text, streamed without building id lists."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(b):
        c = codec(path)
        split = [c.chunks(t or "") for t in b.column(b.schema.get_field_index("text")).to_pylist()]
        n, ids, dec = [], [], []
        c.fill({x for s in split for x in s})
        for s in split:
            got = [c.cache[x] for x in s]
            joined = ",".join([g[0] for g in got])
            n.append(joined.count(",") + 1 if joined else 0)
            ids.append(hashlib.sha256(joined.encode()).hexdigest())
            raw = b"".join([g[1] for g in got])
            dec.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
        return {k: b.column(b.schema.get_field_index(k)) for k in keep} | {"n_tokens": n, "ids_sha256": ids, "decoded_sha256": dec}

    return map_batches(docs.select(*keep, "text"), run, ", ".join(f"`{k}` {types[k]}" for k in keep) + ", n_tokens bigint, ids_sha256 string, decoded_sha256 string", 4 << 20)
