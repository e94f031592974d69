"""op4 and op10 against brute force: every window of every text is counted."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from methylake.llm import common, substring_dedup, suffix_dedup


def covered(tokens, length):
    count = Counter()
    keys = []
    for t in tokens:
        own = [tuple(t[i : i + length]) if isinstance(t, list) else t[i : i + length] for i in range(len(t) - length + 1)]
        keys.append(own)
        count.update(own)
    for t, own in zip(tokens, keys, strict=True):
        mask = [False] * len(t)
        for i, k in enumerate(own):
            if count[k] > 1:
                mask[i : i + length] = [True] * length
        yield mask


def ordered(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=lambda x: tuple((v is None, str(v)) for v in x))


@pytest.mark.parametrize("length", [35, 4])
def test_words(docs, corpus, length):
    tokens = [(t or "").encode().split() for _, t, *_ in corpus]
    want = []
    for (i, *_), t, m in zip(corpus, tokens, covered(tokens, length), strict=True):
        kept = b" ".join(w for w, gone in zip(t, m, strict=True) if not gone)
        want.append({"doc_id": i, "n_words": len(t), "n_removed": sum(m), "kept_sha256": hashlib.sha256(kept).hexdigest()})
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert ordered(substring_dedup.remove_repeated(docs, length).collect(), *names) == ordered(want, *names)


@pytest.mark.parametrize("length", [200, 600, 5])
def test_bytes(docs, corpus, length):
    tokens = [(t or "").encode() for _, t, *_ in corpus]
    want = []
    for (i, *_), t, m in zip(corpus, tokens, covered(tokens, length), strict=True):
        kept = bytes(w for w, gone in zip(t, m, strict=True) if not gone)
        spans = sum(1 for k, x in enumerate(m) if x and (k == 0 or not m[k - 1]))
        want.append({"doc_id": i, "n_bytes": len(t), "n_removed": sum(m), "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest()})
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert ordered(suffix_dedup.remove_repeated(docs, length).collect(), *names) == ordered(want, *names)


def test_outputs_and_edges(docs, empty, clashing):
    out = {r.doc_id: r for r in substring_dedup.remove_repeated(docs, with_text=True).collect() if r.doc_id is not None}
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in out.values())
    for f in (substring_dedup.remove_repeated, suffix_dedup.remove_repeated):
        assert f(empty).count() == 0
        assert f(clashing).count() == docs.count()


def test_lengths_out_of_range(docs):
    for f, lengths in ((substring_dedup.remove_repeated, (0, 2, 200_000)), (suffix_dedup.remove_repeated, (0, 3, 200_000))):
        for n in lengths:
            with pytest.raises(ValueError, match="windows of"):
                f(docs, n)


def test_clashing_text_ids(docs, corpus, monkeypatch):
    """Different texts with the same hash get ids of their own."""
    monkeypatch.setattr(common, "text_id", lambda key: F.xxhash64(key).bitwiseAND(7))
    ws = common.Workspace(docs.sparkSession, "clash")
    texts = common.distinct_texts(ws, docs)
    kinds = {t or "" for _, t, *_ in corpus}
    assert texts.select("tid").distinct().count() == texts.count() == len(kinds)
    named = common.with_tid(ws, docs.select("text", common.content_key().alias("key")))
    assert named.join(texts.select("tid", F.col("text").alias("same")), "tid").where("coalesce(text, '') = same").count() == len(corpus)
    test_words(docs, corpus, 35)


@pytest.mark.parametrize("unique", [False, True])
def test_ranks_over_borders(spark, unique):
    """Dense ranks of pairs, equal for equal pairs, whatever partitions they lie in; a hot pair lies in many."""
    rng = random.Random(1)
    keys = [(7, 7)] * 700 + [(rng.randrange(-9, 9), rng.randrange(9)) for _ in range(150)] + [(100 + i, 0) for i in range(50)] + [(5, -1)]
    rows = [(a, b, i * 3, i, i % 2) for i, (a, b) in enumerate(keys)]
    for part in (rows, rows[:1], rows[:2], [], rows[-30:]):
        ws = common.Workspace(spark, "ranks")
        pairs = ws.put(spark.createDataFrame(part, "a long, b long, tid long, at long, more long"), "pairs")
        got = {r["at"]: r for r in suffix_dedup.ranked(ws, pairs, "ranks", unique).collect()}
        times = Counter((a, b) for a, b, *_ in part)
        assert {i for i, r in got.items() if r["rank"] is not None} == {i for a, b, _, i, _ in part if times[a, b] > 1}
        assert len(got) == (len(part) if unique else sum(n for n in times.values() if n > 1))
        order = sorted(times)
        for a, b, tid, i, more in part:
            if times[a, b] > 1:
                assert (got[i]["rank"], got[i]["tid"], got[i]["more"]) == (order.index((a, b)), tid, more)
