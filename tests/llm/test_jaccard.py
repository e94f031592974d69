from methylake.llm import jaccard_join


def shingles(t):
    w = (t or "").lower().encode().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_brute_force(docs, corpus):
    rows = [(i, shingles(t)) for i, t, *_ in corpus]
    n = len(rows)
    link = [[b for b in range(n) if b != a and rows[a][1] and rows[b][1] and 5 * len(rows[a][1] & rows[b][1]) >= 4 * len(rows[a][1] | rows[b][1])] for a in range(n)]
    comp = list(range(n))
    for _ in range(n):
        for a in range(n):
            comp[a] = min([comp[a], *(comp[b] for b in link[a])])
    least = {c: min((rows[a][0] for a in range(n) if comp[a] == c and rows[a][0] is not None), default=None) for c in set(comp)}
    want = sorted((str(rows[a][0]), len(link[a]), str(least[comp[a]])) for a in range(n))
    got = jaccard_join.join(docs).collect()
    assert sorted((str(r.doc_id), r.n_links, str(r.component_id)) for r in got) == want


def test_dedupe(docs, corpus, empty, clashing):
    joined = jaccard_join.join(docs).collect()
    out = jaccard_join.dedupe(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    void = [t for _, t, *_ in corpus if not (t or "").split()]
    assert len(kept) == len({r.component_id for r in joined if r.doc_id is None or (corpus[r.doc_id][1] or "").split()}) + len(void)
    assert len(kept) == len({(r.doc_id, r.text) for r in kept})
    assert jaccard_join.dedupe(empty).count() == jaccard_join.join(empty).count() == 0
    assert sorted(jaccard_join.dedupe(clashing).columns) == sorted(clashing.columns)


def test_banding():
    for threshold, recall in ((0.8, 0.9995), (0.5, 0.99)):
        bands, rows = jaccard_join.banding(threshold, recall, 500)
        assert 1 - (1 - threshold**rows) ** bands >= recall


def test_large_group_is_blocked(spark):
    """More near copies than a block holds: every link is counted once."""
    base = [f"t{k}" for k in range(300)]
    rows = []
    for i in range(600):
        w = list(base)
        w[i % 300] = f"u{i}"
        rows.append((i, " ".join(w)))
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(599, 0)}
