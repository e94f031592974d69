"""WARC archives with a two-level capture index.

Writing: a record per page, assembled in SQL and written by Spark's text writer, whose
line separator is the CR LF CR LF that ends a WARC record; Spark renames finished files,
so a lost executor leaves no half archive. Among equal payloads the smallest page_id is
the response, the others are revisits that refer to it.

Index: the archives are walked record by record (by Content-Length), keyed by the URL with
its host reversed, sorted by key and page_id (so a much captured URL spreads), and packed in
compressed blocks. A sparse directory has the first key of each block; blocks grow with the
index, so that it has about `MOST` entries at most, and is broadcast.

Lookups (a URL's captures, or one page's) run on executors: bisect the directory, meet the
block, bisect that, then read the record's byte range. Archives in a store that Arrow can
open are read by seek, a record at a time, whatever their size; in any other store Spark
reads them whole and the ranges are cut out (2 GB an archive at most).

Payloads are html in UTF-8, null like empty. Null and odd URLs get the key of their text.
Rows with the least page_id of a payload are all responses if it is repeated; rows without
page_id are revisits if any other row has the payload with an id, else responses. Repeated
rows have a record each. Extra columns are ignored. Archives hold `per_file` records at most.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import urlsplit

from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methylake.llm.common import Workspace, map_batches

END = "\r\n\r\n"
#: The base-32 alphabet and the revisit profile of the format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Entries of the directory, about, at most.
MOST = 1_000_000
ENTRY = "key string, page_id bigint, file string, at bigint, size bigint"
PLACE = "file string, at bigint, size bigint"
#: Order of the captures without page_id, and bounds of a URL's captures.
LEAST, GREATEST = -(1 << 63), (1 << 63) - 1


def digest32(payload) -> F.Column:
    """Upper-case base-32 SHA-1 in SQL: 160 bits are four groups of eight digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def tidy_url(col: str) -> F.Column:
    return F.regexp_replace(col, r"[\r\n\t ]", "%20")


def records(ws: Workspace, pages: DataFrame) -> DataFrame:
    """Column value: the text of each page's record without its end.

    Payloads that occur once need no partner: only repeated ones are looked up, in a table
    of their own whose known size lets Spark broadcast it while it is small.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("key", F.sha2("html", 256))
    first = p.groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    p = p.join(ws.put(first, "repeated"), "key", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    block = F.when(F.col("again"), F.col("http")).otherwise(F.concat("http", "html"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    ref = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    url = F.when(F.col("url").isNull(), "").otherwise(line("WARC-Target-URI", tidy_url("url")))
    p = p.withColumn("again", again).withColumn("http", http).withColumn("block", block)
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
        line("WARC-Record-ID", ref("page_id")),
        url,
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest32(F.col("html")))),
        F.when(F.col("again"), F.concat(line("WARC-Refers-To", ref("first")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    return p.select(F.concat(head, "block").alias("value"))


def write(ws: Workspace, pages: DataFrame, path: str, per_file: int = 1000) -> None:
    records(ws, pages).write.mode("overwrite").option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)


def archives(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Paths and lengths of the archives and, if whole, what is in them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "length", *(["content"] if whole else []))


def _uri(path: str) -> str:
    return re.sub("^file:/+", "file:///", path)


def seekable(path: str) -> bool:
    """Whether Arrow can open this store."""
    try:
        store, inner = stores.FileSystem.from_uri(_uri(path))
        return store.get_file_info(inner).type != stores.FileType.NotFound
    except (OSError, ValueError, NotImplementedError):
        return False


@lru_cache(maxsize=1)
def _opened(path: str):
    store, inner = stores.FileSystem.from_uri(_uri(path))
    return store.open_input_file(inner)


def ranges(path: str, content: bytes | None) -> Callable[[int, int], bytes]:
    """read(at, n) in an archive: by seek, or in its content."""
    if content is not None:
        return lambda at, n: content[at : at + n]
    f = _opened(path)
    return lambda at, n: f.read_at(n, at)


def walk(read: Callable[[int, int], bytes], length: int, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], int, int]]:
    """Headers, place and size of each record; blocks are passed over, not read."""
    at, base, held = 0, 0, b""

    def get(a: int, n: int) -> bytes:
        nonlocal base, held
        if a < base or a + n > base + len(held):
            base, held = a, read(a, max(n, chunk))
        return held[a - base : a - base + n]

    while at < length:
        n, stop = 4096, -1
        while (stop := get(at, min(n, length - at)).find(b"\r\n\r\n")) < 0:
            if n >= length - at:
                raise ValueError(f"no record at byte {at}")
            n *= 4
        head = headers(get(at, stop), at)
        end = at + stop + 4 + int(head["Content-Length"]) + 4
        if get(end - 4, 4) != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield head, at, end - at
        at = end


def surt(url: str | None) -> str:
    """Key of a URL: reversed host, then path and query; scheme, port, fragment and letter case of the host don't matter."""
    try:
        u = urlsplit(url or "")
        host = u.hostname or ""
    except ValueError:
        return url or ""
    if not host:
        return url or ""
    return ",".join(reversed(host.split("."))) + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def headers(data: bytes, at: int) -> dict[str, str]:
    lines = data.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at byte {at}")
    return dict(x.split(": ", 1) for x in lines[1:])


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that starts at a place."""
    stop = data.index(b"\r\n\r\n", at)
    head = headers(data[at:stop], at)
    start, n = stop + 4, int(head["Content-Length"])
    if data[start + n : start + n + 4] != b"\r\n\r\n":
        raise ValueError(f"record at byte {at} is cut short")
    return head, data[start : start + n], start + n + 4


def page_of(urn: str) -> int | None:
    n = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(n) if n else None


def key_of(url: str | None) -> str:
    """A page's key in the index: that of the URL as it stands in its record, without what would end a line or a field."""
    return surt(url).translate({9: 32, 10: 32})


def entries(spark: SparkSession, path: str) -> DataFrame:
    """Walks the archives: (key, page_id, file, at, size)."""
    seek = seekable(path)

    def run(b):
        out = {k: [] for k in ("key", "page_id", "file", "at", "size")}
        for name, length, content in zip(*(b.column(i).to_pylist() for i in range(2)), [None] * b.num_rows if seek else b.column(2).to_pylist(), strict=True):
            for head, at, size in walk(ranges(name, content), length):
                for k, v in zip(out, (key_of(head.get("WARC-Target-URI")), page_of(head["WARC-Record-ID"]), name, at, size), strict=True):
                    out[k].append(v)
        return out

    return map_batches(archives(spark, path, not seek), run, ENTRY, 1 << 26)


def rank(page_id: int | None) -> int:
    return LEAST if page_id is None else page_id


def index(ws: Workspace, path: str, lines: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(blocks: id, first, page, n, data), (directory: id, first, page): sorted by key and page_id, `lines` captures a block or more."""
    e = ws.put(entries(ws.spark, path), "entries")
    n = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    lines = max(lines, -(-e.count() // MOST))

    def run(b):
        rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
        out = {"first": [], "page": [], "n": [], "data": []}
        for i in range(0, len(rows), lines):
            part = rows[i : i + lines]
            text = "\n".join("\t".join("" if v is None else str(v) for v in r) for r in part)
            for k, v in zip(out, (part[0][0], rank(part[0][1]), len(part), zlib.compress(text.encode("utf-8", "surrogatepass"))), strict=True):
                out[k].append(v)
        return out

    order = e.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "at")
    blocks = map_batches(order, run, "first string, page bigint, n bigint, data binary", 1 << 24)
    blocks = ws.put(blocks.select(F.monotonically_increasing_id().alias("id"), "*"), "blocks")
    return blocks, ws.put(blocks.select("id", "first", "page"), "directory")


def unpack(data: bytes) -> list[tuple]:
    rows = (x.split("\t") for x in zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n"))
    return [(k, int(p) if p else None, f, int(a), int(s)) for k, p, f, a, s in rows]


def locate(blocks: DataFrame, directory: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (key, lo, hi), all different: places (file, at, size) of the captures of each key with page_id from lo to hi.

    The wanted keys that bisection of the directory sends to a block meet there in one row;
    they are no more than its captures if each has one.
    """
    entry = sorted((r["first"], r["page"], r["id"]) for r in directory.toLocalIterator())
    held = blocks.sparkSession.sparkContext.broadcast(([(f, p) for f, p, _ in entry], [i for *_, i in entry]))

    def choose(b):
        firsts, ids = held.value
        out = {"id": [], "key": [], "lo": [], "hi": []}
        for key, lo, hi in zip(*(c.to_pylist() for c in b.columns), strict=True):
            # equal firsts stand for several blocks, and the captures may begin before the first of them
            for i in range(max(bisect.bisect_left(firsts, (key, lo)) - 1, 0), bisect.bisect_right(firsts, (key, hi))):
                for k, v in zip(out, (ids[i], key, lo, hi), strict=True):
                    out[k].append(v)
        return out

    chosen = map_batches(wanted.select("key", "lo", "hi"), choose, "id bigint, key string, lo bigint, hi bigint")
    chosen = chosen.groupBy("id").agg(F.collect_list(F.struct("key", "lo", "hi")).alias("wanted"))

    def search(b):
        out = {"file": [], "at": [], "size": []}
        for data, asked in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own = unpack(data)
            keys = [(k, rank(p)) for k, p, *_ in own]
            for q in asked:
                for _, _, *place in own[bisect.bisect_left(keys, (q["key"], q["lo"])) : bisect.bisect_right(keys, (q["key"], q["hi"]))]:
                    for k, v in zip(out, place, strict=True):
                        out[k].append(v)
        return out

    return map_batches(blocks.select("id", "data").join(chosen, "id").select("data", "wanted"), search, PLACE, 1 << 24)


def fetch(spark: SparkSession, path: str, places: DataFrame, make: Callable[[dict, bytes], tuple], schema: str) -> DataFrame:
    """Rows make(headers, block) of the records at the places, by range reads."""
    spots = places.groupBy(F.col("file").alias("path")).agg(F.sort_array(F.collect_list(F.struct("at", "size"))).alias("spots"))  # an archive's records at most
    seek = seekable(path)
    if not seek:
        spots = archives(spark, path).select("path", "content").join(spots, "path")

    def run(b):
        rows = []
        at = b.schema.get_field_index
        for i, asked in enumerate(b.column(at("spots")).to_pylist()):
            read = ranges(b.column(at("path"))[i].as_py(), None if seek else b.column(at("content"))[i].as_py())
            for s in asked:
                rows.append(make(*parse(read(s["at"], s["size"]))[:2]))
        names = re.findall(r"(\w+) \w+(?:,|$)", schema)
        return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else None

    return map_batches(spots, run, schema, 1 << 26)


def facts(head: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record; a response's digest is computed and must agree."""
    http, _, payload = block.partition(b"\r\n\r\n")
    told = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response":
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if own != told:
            raise ValueError(f"digest of {head['WARC-Record-ID']} differs")
        return page_of(head["WARC-Record-ID"]), len(payload), own, "response", None
    size = next(int(x[15:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length:"))
    return page_of(head["WARC-Record-ID"]), size, told, "revisit", page_of(head["WARC-Refers-To"])


def lookup(ws: Workspace, path: str, blocks: DataFrame, directory: DataFrame, urls: list[str]) -> DataFrame:
    """Captures of some URLs: key, page_id, payload."""
    wanted = ws.spark.createDataFrame([(k, LEAST, GREATEST) for k in sorted({key_of(u) for u in urls})], "key string, lo bigint, hi bigint")

    def make(head, block):
        return key_of(head.get("WARC-Target-URI")), page_of(head["WARC-Record-ID"]), block.partition(b"\r\n\r\n")[2]

    return fetch(ws.spark, path, locate(blocks, directory, wanted), make, "key string, page_id bigint, payload binary")


def round_trip(pages: DataFrame, per_file: int = 1000, lines: int = 2000) -> DataFrame:
    """Writes pages, indexes the archives, looks every page up in the index and reads its record back."""
    ws = Workspace(pages.sparkSession, "warc")
    path = ws.path("archives")
    write(ws, pages, path, per_file)
    ws.free()
    blocks, directory = index(ws, path, lines)

    def ask(b):
        ids = [rank(i) for i in b.column(1).to_pylist()]
        return {"key": [key_of(u) for u in b.column(0).to_pylist()], "lo": ids, "hi": ids}

    wanted = map_batches(pages.select(tidy_url("url").alias("url"), "page_id"), ask, "key string, lo bigint, hi bigint").distinct()
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return fetch(ws.spark, path, locate(blocks, directory, wanted), facts, schema)
