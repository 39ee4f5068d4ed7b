"""Archives written, read back and filtered."""

import base64
import gzip
import hashlib
import os

from riskloom.llm import queries, warc
from riskloom.session import scratch_path


def expected(pages, least=0):
    top = {}
    for page, _, html in pages:
        top[html or ""] = max(page, top.get(html or "", page))
    out = set()
    for page, _, html in pages:
        body = (html or "").encode()
        ref = top[html or ""] if len(body) >= least and page < top[html or ""] else None
        out.add((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if ref is None else "revisit", ref))
    return out


def read(spark, path):
    rows = spark.read.format("warc").load(path).select(warc.page_number("record_id").alias("p"), "payload_bytes", "payload_digest", "record_type", warc.page_number("refers_to").alias("r"), "payload", "target_uri")
    return rows.collect()


PAGES = [
    (1, "http://a/b c%20\r\nX: y", "same"), (2, None, "same"), (3, "http://c/é", None), (4, "", ""), (5, "u", "WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"),
    (6, "u", "ü" * 400_000), (7, " u ", "same"), (-8, "u", "\x00\n"), (9, "u", "long " * 50), (10, "u", "long " * 50),
]


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("record_type", warc.F.lit("x"))
    for least in (0, 100):
        path = scratch_path(spark, "test-warc")
        warc.archive(pages, path, least)
        got = read(spark, path)
        assert {(r["p"], r["payload_bytes"], r["payload_digest"].removeprefix("sha1:"), r["record_type"], r["r"]) for r in got} == expected(PAGES, least)
        texts, urls = {p: h or "" for p, _, h in PAGES}, {p: u for p, u, _ in PAGES}
        assert all(bytes(r["payload"]).decode() == ("" if r["record_type"] == "revisit" else texts[r["p"]]) and r["target_uri"] == urls[r["p"]] for r in got)


def test_repeated_id_with_two_payloads(spark):
    path = scratch_path(spark, "test-warc")
    rows = [(1, "u", "same text"), (1, "u", "other text"), (2, "v", "same text"), (None, "w", "same text")]
    warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = spark.read.format("warc").load(path).select("target_uri", "record_type", "payload_bytes", "payload", warc.page_number("refers_to")).collect()
    assert sorted(tuple(r)[:3] for r in got) == [("u", "response", 10), ("u", "revisit", 9), ("v", "response", 9), ("w", "response", 9)]
    assert {bytes(r["payload"]) for r in got if r["record_type"] == "response"} == {b"same text", b"other text"}
    assert [r[4] for r in got if r["record_type"] == "revisit"] == [2]


def test_pushed_filters_and_unread_payloads(spark):
    path = scratch_path(spark, "test-warc")
    warc.archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    table = spark.read.format("warc").load(path)
    only = table.where("record_type = 'revisit' and payload_bytes < 10")
    assert {r["refers_to"] for r in only.collect()} == {"<urn:page:7>", "<urn:page:4>"}
    assert table.where("target_uri in ('u', 'v')").count() == 5
    assert table.where("record_type = 'revisit' and record_type = 'response'").count() == 0
    unread = spark.read.format("warc").option("payloads", "false").load(path)
    assert {r["payload"] for r in unread.collect()} == {None}


def test_header_predicates_skip_payloads():
    class Source:
        def __init__(self, data):
            self.data, self.at, self.got = data, 0, 0

        def read(self, n):
            out = self.data[self.at : self.at + n]
            self.at += len(out)
            self.got += len(out)
            return out

        def seek(self, n, whence):
            self.at += n

    row = {"record_id": "a", "record_type": "response", "payload_bytes": 1 << 24, "payload": b"x" * (1 << 24)}
    source = Source(warc.record(row) * 3 + warc.record(row | {"record_type": "resource", "payload": b"y", "payload_bytes": 1}))
    got = list(warc.records(warc._Buffered(source), {"record_type": {"resource"}}, ["record_type", "payload"]))
    assert got == [("resource", b"y")] and source.got < 2 << 20


def test_empty_and_nulls(spark):
    path = scratch_path(spark, "test-warc")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.archive(pages, path)
    assert read(spark, path) == []
    warc.archive(spark.createDataFrame([(None, None, None), (1, "u", "a"), (1, "u", "a")], pages.schema), path)
    got = read(spark, path)
    assert sorted((str(r["p"]), r["record_type"]) for r in got) == [("1", "response"), ("1", "response"), ("None", "response")]


def crawled(kind, payload, http=b"", **headers):
    """A record as a crawler writes it."""
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *(f"{k.replace('_', '-')}: {v}" for k, v in headers.items()), f"Content-Length: {len(http + payload)}"]
    return "\r\n".join([*lines, "", ""]).encode() + http + payload + b"\r\n\r\n"


def test_compressed_files_messages_and_any_bytes(spark):
    root = scratch_path(spark, "crawl").removeprefix("file:")
    os.makedirs(root)
    http = b"HTTP/1.1 200 OK\r\nX-\xe9: y\r\nContent-Length: 7\r\n\r\n"
    records = [
        crawled("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"),
        crawled("response", b"\xff\xfe\x00\r\n\r\n", http, Content_Type="application/http; msgtype=response", WARC_Target_URI="http://a/"),
        crawled("response", b"y" * 700_000, http, Content_Type="application/http;msgtype=response", WARC_Target_URI="http://b/"),
        crawled("response", b"", b"HTTP/1.1 304 no body", Content_Type="application/http", WARC_Target_URI="http://c/"),
        crawled("resource", b"plain", WARC_Target_URI="http://d/"),
    ]
    with open(f"{root}/crawl.warc.gz", "wb") as out:
        out.write(b"".join(gzip.compress(r) for r in records))  # one member for each record
    with open(f"{root}/plain.warc", "wb") as out:
        out.write(b"".join(records))
    warc.register(spark)
    table = spark.read.format("warc").load(f"file://{root}")
    want = sorted([("http://a/", 7, b"\xff\xfe\x00\r\n\r\n"), ("http://b/", 700_000, b"y" * 700_000), ("http://c/", 0, b"")] * 2)
    got = table.where("record_type = 'response'").collect()
    assert sorted((r["target_uri"], r["payload_bytes"], bytes(r["payload"])) for r in got) == want
    assert {r["http_headers"].splitlines()[0] for r in got} == {"HTTP/1.1 200 OK", "HTTP/1.1 304 no body"}
    unread = table.where("record_type in ('response', 'resource')").select("target_uri", "payload_bytes").collect()
    assert sorted(tuple(r) for r in unread) == sorted([*((u, n) for u, n, _ in want), ("http://d/", 5), ("http://d/", 5)])


def test_query(spark, sf):
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert {tuple(r) for r in queries.QUERIES["op7_warc"](spark, sf).collect()} == expected(pages)
