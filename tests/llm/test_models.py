"""Language ID, toxicity and decontamination: held-out accuracy, planted cases, edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from methylake.llm import decontam, langid, queries, toxicity


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    protos = langid.train(docs.where("not held_out"))
    assert set(protos) == {"de", "en", "es", "fr"}
    out = langid.predict(docs, protos, keep=("doc_id", "held_out", "lang")).where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)
    assert zlib.crc32(b"1") % 4 == docs.select(F.crc32(F.lit("1")) % 4).first()[0]


def test_language_edges(spark, docs, empty, clashing):
    protos = langid.train(docs)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (4, "İstanbul straße")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(rows, protos).collect()}
    assert [(got[i].lang_pred, got[i].score) for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[4].lang_pred in protos
    assert langid.train(empty) == {}
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}
    assert langid.predict(clashing, protos).count() == docs.count()
    assert langid.predict(empty, protos).count() == 0


def test_language_ties_copies_and_shares(spark, clashing):
    rows = [(i, t, k) for i, (t, k) in enumerate([("aaaa bbbb", "x"), ("cccc dddd", "y")] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    protos = langid.train(df)
    assert all((protos[k] == langid.train(df.limit(2))[k]).all() for k in ("x", "y"))  # copies count once
    assert {r.lang_pred for r in langid.predict(df.select("doc_id", "text"), {"b": protos["x"], "a": protos["x"]}).collect()} == {"a"}  # ties go to the first name
    assert set(langid.train(clashing)) == {"de", "en"}
    # a share of the hashes, however many rows there are: never none
    assert langid.share(20_000, 10**11) > 0 and langid.share(20_000, 10**30) == 1
    assert abs(langid.share(20_000, 40_000) / 2**60 - 0.5) < 1e-9


def test_bundle_is_the_sum_of_bound_letters():
    v = langid.bundles(["ab"], 128, 7)[0]
    L = lambda c: langid.letter(ord(c) if c else 0, 128, 7).astype(int)
    want = np.roll(L(""), 2) * np.roll(L("a"), 1) * L("b") + np.roll(L("a"), 2) * np.roll(L("b"), 1) * L("")
    assert (v == want).all()
    many = ["Hello world", "x", "", None, "ÀÉ 12 à"]
    assert (langid.bundles(many, 128, 7) == np.stack([langid.bundles([t], 128, 7)[0] for t in many])).all()


def test_toxicity(spark):
    rng = random.Random(3)
    plain = [f"w{k:03d}ab" for k in range(300)]
    rows = []
    for i in range(900):
        w = [rng.choice(plain) for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(["wretchful", "spitegrin", "foulmouth"])
        rows.append((i, " ".join(w), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.where("doc_id < 600").select("text", "toxic"))
    out = {r.doc_id: r for r in toxicity.score(df.where("doc_id >= 600"), model).collect()}
    assert all(out[i].predicted == t for i, _, t in rows[600:])
    assert toxicity.auc(np.array([out[i].score for i in out]), np.array([rows[i][2] for i in out])) == 1.0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !")], "doc_id long, text string")
    assert {r.predicted for r in toxicity.score(odd, model).collect()} == {0}
    assert toxicity.fit(df.limit(0).select("text", "toxic")) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
    assert 0 < toxicity.sample(df, df.select("doc_id", "toxic"), 100).count() < 300


def test_toxicity_held_out(spark):
    """Held-out labels of a larger table: in every language, stems are caught whatever their endings."""
    sf = "/root/testdata/sf0.1"
    out = queries.op5_toxicity(spark, sf).where("held_out")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = out.join(docs, "doc_id").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    assert toxicity.auc(np.array([r.score for r in rows]), np.array([r.toxic for r in rows])) >= 0.9
    assert np.mean([r.predicted for r in rows if not r.toxic]) <= 0.03
    for lang in ("de", "en", "es", "fr"):
        assert np.mean([r.predicted for r in rows if r.toxic and r.lang == lang]) >= 0.6
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.fixture(scope="module")
def stems():
    """Toxic texts hold words with one of two stems and any ending; ordinary ones don't."""
    rng = random.Random(9)
    part = ["an", "ber", "ti", "ko", "lu", "sen", "dra", "mo", "fi", "gel"]
    word = lambda: "".join(rng.choice(part) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(900):
        w = [word() for _ in range(80)]
        if i % 6 == 0:
            for _ in range(5):
                w[rng.randrange(80)] = rng.choice(["zwirbq", "plomxu"]) + word()
        rows.append((i, " ".join(w), int(i % 6 == 0)))
    return rows


def test_toxicity_stems_and_edges(spark, stems, empty, clashing):
    df = spark.createDataFrame(stems, "doc_id long, text string, toxic int")
    twice = df.where("doc_id < 600").select("text", "toxic")
    model = toxicity.fit(twice.union(twice))
    assert model == toxicity.fit(twice)  # copies count once
    rest = [(i, t, y) for i, t, y in stems if i >= 600]
    long = " ".join(t for _, t, y in stems if not y)
    odd = [(9000, long, 0), (9001, long + " zwirbqan" * 300, 0), (9002, rest[0][1], 0), (9002, rest[0][1], 0)]
    out = toxicity.score(spark.createDataFrame(rest + odd, "doc_id long, text string, toxic int"), model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rest) + 4 and np.mean([by[i].predicted == y for i, _, y in rest]) >= 0.99
    assert (by[9000].predicted, by[9001].predicted) == (0, 1)
    assert len({r.score for r in out if r.doc_id in (9002, rest[0][0])}) == 1  # repeated texts tie
    assert toxicity.score(empty, model).count() == 0
    extra = clashing.withColumns({c: F.lit(1) for c in ("score", "predicted", "features", "toxic", "piece", "code")})
    assert toxicity.score(extra, model).count() == clashing.count()
    assert toxicity.fit(df.where("toxic = 0").select("text", "toxic")) is None
    assert toxicity.fit(df.where("doc_id < 60").select("text", F.expr("cast(doc_id % 2 as int)").alias("toxic"))) is None  # nothing tells the labels apart


def test_gain_needs_shared_bytes():
    p = toxicity.pair(b" sen ber ti ko lu dra", b" zwirbq", np.unique(toxicity.grams(b" zwirbq")).tobytes())
    assert p.features([None, "", "12 !", "sen ber ti"]).tolist() == [[0.0] * 4] * 4
    assert (p.features(["sen ber zwirbq ti ko zwirbqan lu"])[0] > 0).any()


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(4)
    voc = [f"t{k}" for k in range(3000)]
    text = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    items = [(k, text(rng.randrange(15, 60))) for k in range(40)]
    docs, want = [], {}
    for i in range(200):
        t = text(rng.randrange(0, 200))
        if i % 5 == 0:
            k = i % 40
            w = items[k][1].split()
            if i % 2:
                del w[len(w) // 3]  # a word is missing
            t = f"{t} {' '.join(w).upper()}. {text(30)}"
            want[i] = [k]
        docs.append((i, t))
    docs += [(200, None), (201, ""), (202, items[3][1]), (203, items[3][1])]
    want |= {202: [3], 203: [3]}
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (None, "x")], "item_id long, text string")
    return spark.createDataFrame(docs, "doc_id long, text string"), bench, want


@pytest.mark.parametrize("block", [2000, 15])
def test_decontamination(leaks, block):
    docs, bench, want = leaks
    got = {r.doc_id: sorted(r["items"]) for r in decontam.scan(docs, bench, block=block).collect()}
    assert {i: v for i, v in got.items() if v} == want and len(got) == 204


def test_decontamination_block_sums():
    rng = np.random.default_rng(3)
    emb = np.vstack((rng.standard_normal((50, 6)), np.zeros(6))).astype(np.float32)
    lens = np.array([0, 1, 7, 8, 0, 9, 100, 16, 0])
    idx = rng.integers(-1, 50, int(lens.sum()))
    ends = np.cumsum(lens)
    want = [emb[idx[i : min(i + decontam.STEP, e)]].sum(0) for n, e in zip(lens, ends, strict=True) for i in range(e - n, e, decontam.STEP)]
    assert np.allclose(decontam.block_sums(emb, idx, lens), want, atol=1e-5)


def test_decontamination_edges(leaks, docs, empty, clashing):
    _, bench, _ = leaks
    assert decontam.scan(empty, bench).count() == 0
    assert {len(r["items"]) for r in decontam.scan(docs, bench.limit(0)).collect()} == {0}
    assert decontam.scan(clashing, bench).count() == docs.count()


def test_items_of_one_id_and_passes(spark, leaks, monkeypatch):
    """An id counts once with its best text, in whatever block or pass its texts are."""
    docs, bench, want = leaks
    twice = bench.union(bench).union(spark.createDataFrame([(3, "nothing of this is anywhere in the documents at all")], "item_id long, text string"))
    results = []
    for most in (decontam.MOST, 1):
        monkeypatch.setattr(decontam, "MOST", most)
        for block in (2000, 15):
            found = decontam.scan(docs, twice, block=block).collect()
            assert {r.doc_id: r["items"] for r in found if r["items"]} == want
            results.append({r.doc_id: r.shares for r in found})
    assert all(r == results[0] for r in results)


def test_sparse_factors():
    rng = np.random.default_rng(2)
    idx, row = rng.integers(-1, 30, 400), np.sort(rng.integers(0, 12, 400))
    idf = rng.random(30) + 0.5
    r, t, v = decontam._tfidf(idx, row, 12, idf)
    dense = np.zeros((12, 30))
    for i, k in zip(idx, row, strict=True):
        if i >= 0:
            dense[k, i] += idf[i]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    got = np.zeros((12, 30))
    got[r, t] = v
    assert np.allclose(got, dense)
    omega = rng.random((30, 5))
    assert np.allclose(decontam._spread(r, v[:, None] * omega[t], 12), dense @ omega)
    assert decontam._spread(np.empty(0, int), np.empty((0, 5)), 3).shape == (3, 5)


@pytest.mark.parametrize("scale", [1, 1000])
def test_decontamination_at_scale(spark, monkeypatch, scale):
    """Items are found whatever the number of documents, their words' shares being the same, as by brute force over all windows."""
    rng = random.Random(8)
    common = [f"c{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(common) if rng.random() < 0.5 else f"r{k}x{j}" for j in range(15 + k))) for k in range(20)]
    rows = []
    for i in range(200):
        words = [rng.choice(common) if rng.random() < 0.3 else f"f{i}y{j}" for j in range(60)]
        if i % 2 == 0:
            item = items[i % 20][1].split()
            words[11 + i % 40 : 11 + i % 40] = item[: len(item) - i % 5]
        rows.append((i, " ".join(words)))
    count = decontam.frequencies
    monkeypatch.setattr(decontam, "frequencies", lambda d, v: tuple(x * scale for x in count(d, v)))
    found = decontam.scan(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()

    def brute(text, item):
        w, n, best = decontam.terms(text), len(item), 0.0
        cut = decontam.answer_at("", n)
        for at in range(0, len(w), decontam.STEP):
            near = w[max(0, at - n) : at + decontam.STEP * decontam.WIDE + n]
            got = decontam.lcs(item, near) / n
            if got >= 0.8 or got >= 0.6 and decontam.lcs(item[cut:], near) >= 0.8 * (n - cut):
                best = max(best, got)
        return best

    want = {i: {k: s for k, item in items if (s := brute(t, decontam.terms(item)))} for i, t in rows}
    assert {r.doc_id: dict(zip(r["items"], r["shares"], strict=True)) for r in found} == want
    assert sum(map(len, want.values())) >= 80


def test_lcs():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(6)
    for _ in range(50):
        a, b = ([bytes([rng.randrange(97, 103)]) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        assert decontam.lcs(a, b) == plain(a, b)
    assert decontam.answer_at("what is it? the answer here", 6) == 3
