import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from methylake.llm import warc
from methylake.llm.common import Workspace

PAGES = [(1, "http://a.example.org/x?q=1#f", "<p>one</p>"), (2, "https://b.example.org:8080/y", "<p>two\r\n\r\nWARC/1.1 é</p>"), (3, None, None), (4, "http://[bad", ""), (5, "http://a.example.org/x?q=1", "<p>one</p>"), (0, "http://c.example.org/a b\nc", "<p>one</p>"), (None, "http://é.org", "<p>one</p>"), (6, "http://z.org", "z" * 100_000), (6, "http://z.org", "z" * 100_000)]


@pytest.fixture(params=[True, False], ids=["seek", "whole"])
def store(request, monkeypatch):
    """Archives in a store that Arrow opens, and in one that only Spark reads."""
    if not request.param:
        monkeypatch.setattr(warc, "seekable", lambda path: False)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string")


@pytest.mark.parametrize("lines", [1, 2000])
def test_round_trip(spark, pages, store, lines):
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        again = i != first[h or ""]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in warc.round_trip(pages, 2, lines).collect())


def test_edges(pages):
    assert warc.round_trip(pages.limit(0)).count() == 0
    names = ("key", "first", "block", "http", "again", "value", "n", "id", "file", "at", "size", "lo", "hi", "path", "spots")
    extra = pages.select("*", *(F.lit(1).alias(c) for c in names))
    assert sorted(map(str, warc.round_trip(extra).collect())) == sorted(map(str, warc.round_trip(pages).collect()))


def test_many_captures_and_large_records(spark):
    """One URL with most captures (over many blocks, ids repeated), records beyond the walk's chunk, one archive."""
    rows = [(i // 2, "http://hot.example/", f"<p>{i // 2}</p>") for i in range(60)] + [(100 + i, f"http://h{i}.example/", "é" * 700_000 + str(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    got = warc.round_trip(df, per_file=1000, lines=3).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in got) == sorted((i, len(h.encode()), "response") for i, _, h in rows)


def test_index_and_lookup(spark, pages, store):
    ws = Workspace(spark, "test")
    path = ws.path("a")
    warc.write(ws, pages, path, per_file=3)
    for f in warc.archives(spark, path).collect():  # records follow each other to the last byte
        data = bytes(f.content)
        at, told = 0, list(warc.walk(lambda a, n, d=data: d[a : a + n], len(data), 16))
        for head, place, size in told:
            assert place == at and warc.parse(data, at)[0] == head and head["WARC-Type"] in ("response", "revisit")
            at = warc.parse(data, at)[2]
            assert at == place + size
        assert at == len(data)
    blocks, directory = warc.index(ws, path, lines=2)
    assert directory.count() == blocks.count() >= 3
    keys = [e[0] for r in blocks.orderBy("first", "page").collect() for e in warc.unpack(r["data"])]
    assert len(keys) == len(PAGES) and keys == sorted(keys)
    got = warc.lookup(ws, path, blocks, directory, ["https://A.example.org/x?q=1", "http://nowhere.org/", "http://z.org/"]).collect()
    assert sorted(r.page_id for r in got) == [1, 5, 6, 6]
    assert {bytes(r.payload) for r in got if r.page_id == 6} == {b"z" * 100_000}
    with pytest.raises(ValueError, match="no record"):
        warc.parse(b"junk\r\n\r\n", 0)
    with pytest.raises(ValueError, match="no record"):
        list(warc.walk(lambda a, n: b"junk"[a : a + n], 4))
    with pytest.raises(ValueError, match="cut short"):
        list(warc.walk(lambda a, n: b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"[a : a + n], 33))
    assert not warc.seekable("viewfs://store/in")


def test_surt():
    assert warc.surt("http://m.Ex.org:80/a?b=1#c") == "org,ex,m)/a?b=1"
    assert (warc.surt(None), warc.surt("plain"), warc.surt("http://x.org")) == ("", "plain", "org,x)/")
