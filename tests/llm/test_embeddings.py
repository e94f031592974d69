import numpy as np

from methylake.llm import embed_dedup


def test_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 64))
    vecs = [*base]
    for c in range(20):
        vecs += [base[c] + rng.standard_normal(64) * rng.uniform(0.05, 0.4) for _ in range(4)]
    vecs += [base[30] + rng.standard_normal(64) * 0.15 for _ in range(300)]  # more than a block, more than a bucket
    vecs += [base[7]] * 20 + [base[8] * 3]
    rows = [(i, v.astype("float32").tolist()) for i, v in enumerate(vecs)]
    n = len(rows)
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [None] + [1.0] * 63, [float("inf")] + [1.0] * 63]
    rows += [(n + k, v) for k, v in enumerate(odd)] + [(n + 10, [1.0, 2.0]), (n + 11, [2.0, 4.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, tid int")
    got = {r.vec_id: r for r in embed_dedup.near(df).collect()}
    x = np.array([r[1] for r in rows[:n]], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T >= 0.95
    np.fill_diagonal(s, False)
    label = np.arange(n)
    for _ in range(n):
        label = np.where(s | np.eye(n, dtype=bool), label[None, :], n).min(1)
    found = sum(got[i].n_links for i in range(n))
    assert all(got[i].n_links <= s[i].sum() for i in range(n))
    assert found >= 0.99 * s.sum()
    assert np.mean([got[i].component_id == label[i] for i in range(n)]) >= 0.99
    assert all((got[n + k].n_links, got[n + k].component_id, got[n + k].kept) == (0, n + k, True) for k in range(len(odd)))
    assert (got[n + 11].n_links, got[n + 11].component_id, got[n + 11].kept) == (1, n + 10, False)
    assert embed_dedup.near(df.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    """Rows with one id or none are rows of their own; component ids ignore null ids while there are others."""
    a, b = [1.0] + [0.0] * 31, [0.0] * 31 + [1.0]
    rows = [(1, a), (1, a), (2, a), (None, a), (3, b), (3, [x * 2 for x in b]), (None, None)]
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embed_dedup.near(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == sorted([("1", 3, 1, True)] * 2 + [("2", 3, 1, False), ("None", 3, 1, False)] + [("3", 1, 3, True)] * 2 + [("None", 0, None, True)])


def test_estimates_are_unbiased():
    rng = np.random.default_rng(1)
    a = rng.standard_normal(64)
    b = a + rng.standard_normal(64)
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    est = []
    for k in range(400):
        r = embed_dedup.rotation(64, 100 + k, 3)
        p, q = r @ a, r @ b
        c = np.where(p > 0, 1, -1) / 8
        est.append((c @ q) / (c @ p))
    assert abs(np.mean(est) - a @ b) < 0.02
