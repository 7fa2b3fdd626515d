import base64
import bisect
import hashlib
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.llm import warc
from tessera.llm.common import scratch
from tessera.llm.queries import op6_warc


def expected(pages, least=0):
    first = {}
    for i, _, h in pages:
        d = hashlib.sha1((h or "").encode()).digest()
        first[d] = min(first.get(d, i), i)
    out = []
    for i, _, h in pages:
        payload = (h or "").encode()
        d = hashlib.sha1(payload).digest()
        revisit = len(payload) >= least and first[d] != i
        out.append((i, len(payload), base64.b32encode(d).decode(), "revisit" if revisit else "response", first[d] if revisit else None))
    return sorted(out, key=str)


def test_query(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, op6_warc(spark, sf_dir).collect()), key=str) == expected(pages)


PAGES = [
    (3, "http://b.example.org/x?q=1", "<p>same</p>"), (1, "http://b.example.org/x?q=1", "<p>same</p>"), (2, "https://a.example.org:8080/é", "WARC/1.0\r\n\r\n\r\nWARC/1.0\r\nContent-Length: 3"),
    (4, None, None), (5, "", ""), (6, "not a url\r\nX-Evil: 1", "\r\n\r\n"), (7, "http://[bad", "short"), (8, "http://c.example.org/", "short"), (9, "http://c.example.org/", "é" * 50_000),
]


def test_round_trip_and_lookup(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for least in (0, 8):
        index = warc.index(spark, warc.write(df, scratch(spark, "w"), least), scratch(spark, "i"), block=2, entries=2)
        number = lambda x: None if x is None else int(x)
        assert len(index.files) > 1
        rows = [r.asDict() | {"page_id": number(r.page_id), "refers_to": number(r.refers_to)} for r in index.lookup_all(df).collect()]
        assert len(rows) == index.read_all().count()
        rows = [Row(**r) for r in rows]
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == expected(PAGES, least)
        html = {i: h or "" for i, _, h in PAGES}
        for r in rows:
            assert r.payload is None if r.record_type == "revisit" else bytes(r.payload).decode() == html[r.page_id]
        assert [r["page_id"] for r in index.lookup("http://b.example.org/x?q=1")] == ["1", "3"]
        assert [r["page_id"] for r in index.lookup("http://c.example.org/")] == ["8", "9"]
        assert [r["page_id"] for r in index.lookup(None)] == ["4"]
        assert index.lookup("http://zzz.example/") == [] and index.lookup("http://a.example/") == []
        wanted = spark.createDataFrame([("http://c.example.org/",), ("http://c.example.org/",), (None,), ("http://zzz/",)], "url string")
        assert sorted(r.page_id for r in index.lookup_all(wanted).collect()) == ["4", "8", "9"]
        assert index.lookup_all(wanted.limit(0)).count() == 0


def test_repeated_null_and_no_rows(spark):
    rows = [(1, "u", "x"), (1, "u", "x"), (None, "u", "x"), (2, "u", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.archive_and_read(df).collect())
    assert found == [("1", "response", None), ("1", "response", None), ("2", "revisit", 1), ("None", "revisit", 1)]
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_ids_of_any_type(spark):
    ids = ["a%0Ab", "x\ny", "10", "%25", "é", None]
    df = spark.createDataFrame([(i, "http://h/", f"page of {i}") for i in ids] + [("0", "http://h/", "page of 10")], "page_id string, url string, html string")
    found = {(r.page_id, r.record_type, r.refers_to) for r in warc.archive_and_read(df).collect()}
    assert found == {(i, "response", None) for i in ids if i != "10"} | {("10", "revisit", "0"), ("0", "response", None)}


def test_directory_finds_every_block(spark):
    """Against a plain scan of the blocks' key ranges, with keys that fill several blocks and files."""
    rng = random.Random(2)
    urls = [f"http://h{rng.randrange(4)}.org/{rng.randrange(12)}" for _ in range(400)]
    df = spark.createDataFrame([(k, u, f"{k}") for k, u in enumerate(urls)], "page_id long, url string, html string")
    index = warc.index(spark, warc.write(df, scratch(spark, "w")), scratch(spark, "i"), block=5, entries=7)
    blocks = [(r.part, r.number, [c.key for c in index.captures(index.blocks.where((F.col("part") == r.part) & (F.col("number") == r.number))).collect()]) for r in index.blocks.select("part", "number").collect()[:12]]
    directory = warc.Directory(index.files)
    assert len(index.files) >= 10 and [k for k, _ in index.files] == sorted(k for k, _ in index.files)
    for part, number, keys in blocks:
        assert keys == sorted(keys) and all((part, number) in set(directory.blocks(k)) for k in keys)
        assert bisect.bisect_left(directory.first, keys[0]) <= len(index.files)
    for u in sorted(set(urls))[:3]:
        assert [int(r["page_id"]) for r in index.lookup(u)] == [k for k, x in enumerate(urls) if x == u]
    assert index.lookup_all(df.where("page_id < 50")).count() == sum(u in set(urls[:50]) for u in urls)


def test_key():
    assert warc.reversed_host_key("http://WWW.Ex.org:81/a?b#c") == "org,ex,www:81)/a?b#c"
    assert warc.reversed_host_key(None) == "" and warc.reversed_host_key("x") == "x"
