"""The operators' SQL against the operators, on invented tables with every edge case."""

import duckdb
import pytest

from methylake.llm import embed_dedup, jaccard_join, oracles, substring_dedup, suffix_dedup, warc


def same(df, con, sql):
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=key)


@pytest.fixture
def con(docs, tmp_path):
    con = duckdb.connect()
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    return con


def test_texts(docs, con):
    same(substring_dedup.remove_repeated(docs), con, oracles.REMOVED_WORDS)
    same(suffix_dedup.remove_repeated(docs), con, oracles.REMOVED_BYTES)
    same(jaccard_join.join(docs.where("doc_id is not null")), con, oracles.NEAR_TEXTS.replace("FROM documents", "FROM documents WHERE doc_id IS NOT NULL"))


def test_pages(spark, con, tmp_path):
    rows = [(1, "http://a.org/x", "one"), (2, "u", "two é"), (3, None, None), (4, "v", ""), (5, "w", "one"), (0, "w", "one")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    df.coalesce(1).write.parquet(str(tmp_path / "p"))
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/p/*.parquet'")
    same(warc.round_trip(df), con, oracles.CAPTURES)


def test_vectors(spark, con, tmp_path):
    rows = [(0, [1.0, 0.0, 0.2]), (1, [1.0, 0.05, 0.2]), (2, [1.0, 0.0, 0.2]), (3, [0.0, 0.0, 0.0]), (4, None), (5, [float("nan"), 1.0, 1.0]), (6, [0.0, 1.0]), (7, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    df.coalesce(1).write.parquet(str(tmp_path / "v"))
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/v/*.parquet'")
    same(embed_dedup.near(df), con, oracles.NEAR_VECTORS)
