import corpus_pipeline
from tokenizers import Tokenizer

from methylake.llm import jaccard_join, queries


def test_stages(spark, sf, docs, empty, clashing):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "decontamination", "pii", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, clashing, sf).columns == clashing.columns
    assert corpus_pipeline.encoding(spark, clashing, sf).count() == clashing.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert name == "bpe" or out.columns == docs.columns
        assert out.count() <= docs.count()
        assert stage(spark, empty, sf).count() == 0


def test_language_stage(spark, sf):
    """Foreign texts go if they are long enough to tell; without labels, what has letters stays."""
    english = "the old house stands near the river and the children play there every day "
    rows = [(i, english * 3, "en" if i else None) for i in range(5)] + [(9, "ђ" * 20, None), (10, "щъыьэюя ђѓєѕіїј њћќѝўџ " * 4, None), (11, None, "en"), (12, "12 34", "en"), (13, "the old house", None)]
    df = spark.createDataFrame([(i, t, k, None, len(t or "")) for i, t, k in rows], "doc_id bigint, text string, lang string, source string, n_chars int")
    kept = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, df, sf).collect()}
    assert kept == {**{i: "en" for i in range(5)}, 9: "en", 13: "en"}
    bare = df.selectExpr("doc_id", "text", "cast(null as string) lang", "cast(null as string) source", "1 n_chars")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, bare, sf).collect()} == {0, 1, 2, 3, 4, 9, 10, 13}


def test_redaction_stage(spark, sf):
    rows = [(0, "mail a@b.org or 10.0.0.1 now", 28), (1, None, None), (2, 'token = "' + "0a" * 20 + '" end', 54), (2, "plain", 5)]
    out = corpus_pipeline.redaction(spark, spark.createDataFrame([(i, t, "en", "s", n) for i, t, n in rows], "doc_id bigint, text string, lang string, source string, n_chars int"), sf).collect()
    got = sorted((r.doc_id, r.text, r.n_chars) for r in out if r.text is not None)
    assert got == [(0, "mail [EMAIL] or [IP] now", 24), (2, "plain", 5), (2, 'token = "[SECRET]" end', 22)] and len(out) == 4


def test_run(spark, sf):
    import public_tokenizers

    source = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, sf).collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) and set(ids) <= set(source)
    kept = {r.component_id for r in jaccard_join.join(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    bench = [r.text.lower() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {i for i, r in source.items() if any(b in r.text.lower() for b in bench)}
    assert set(ids) == kept - leaked
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in out[:40]:
        text = t.decode(r.ids, skip_special_tokens=False)
        assert text == source[r.doc_id].text or "[" in text
        assert "@mail" not in text


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)}
    assert "pipeline" in names and set(queries.oracle_sql()) <= set(names)


def test_query_columns(spark, sf):
    want = {"op1_language_id": {"doc_id", "held_out", "lang_pred", "score"}, "op5_toxicity": {"doc_id", "held_out", "score", "predicted"}, "op8_decontamination": {"doc_id", "contaminated", "items"}}
    for name, columns in want.items():
        assert columns <= set(getattr(queries, name)(spark, sf).columns)
