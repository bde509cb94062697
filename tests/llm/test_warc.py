from __future__ import annotations

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from commentlens.llm import warc

SCHEMA = "page_id long, url string, html string"
PAGES = [
    (1, "http://a.example/x", "same"), (2, "http://b.example/y?z=1", "same"), (9, "http://c.example", "same"), (3, "http://a.example/x", None), (4, "http://d.example/", ""),
    (5, "http://e.example/a b\r\nEvil: 1", "line\r\n\r\nends\r\n\r\n"), (6, None, "no url"), (7, "http://f.example", "tells WARC/1.1\r\nWARC-Type: response\r\n\r\n of itself"),
    (8, "http://g.example/ü", "ünï 日本   😂"), (10, "http://h.example", "WARC/1."), (11, "http://i.example", "long " * 200_000), (12, "http://j.example", "twice"), (12, "http://j.example", "twice"),
    (12, "http://k.example", "twice"), (None, "http://l.example", "lost"), (None, None, "lost"), (13, "", "x\n"),
]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected(pages, least=0):
    """page_id, bytes, digest, type, refers_to: the largest (page, url), null lowest, answers; the first of equal rows."""
    order = lambda i, u: (i is not None, i or 0, u is not None, u or "")
    top = {}
    for i, u, html in pages:
        top[html or ""] = max(top.get(html or "", (False,)), order(i, u))
    out, used = [], set()
    for i, u, html in pages:
        body = (html or "").encode()
        first = order(i, u) == top[html or ""] and html not in used
        if len(body) < least or first:
            used.add(html) if first else None
            out.append((i, len(body), digest(body), "response", None))
        else:
            out.append((i, len(body), digest(body), "revisit", top[html or ""][1] if top[html or ""][0] else None))
    return sorted(out, key=str)


def read_back(spark, path):
    rows = warc.assemble(warc.read_records(spark, path)).collect()
    kept = {r.id: r for r in rows}
    out = []
    for r in rows:
        key = r.metadata.fields["capture-key"]
        target = kept[r.capture.refers_to].metadata.fields["capture-key"] if r.capture.refers_to else ""
        assert r.request.headers.startswith("GET /") and r.n_sides == 2 and r.capture.intact
        assert r.capture.type == "revisit" or digest(r.capture.payload) == r.capture.digest
        out.append((int(key) if key else None, r.capture.payload_bytes, r.capture.digest, r.capture.type, int(target) if target else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_pages_come_back(spark, tmp_path, least):
    pages = spark.createDataFrame(PAGES, SCHEMA).repartition(3).withColumns({"digest": F.lit("clash"), "key": F.lit(1), "copies": F.lit(2)})
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path, min_revisit_bytes=least)
    assert warc.torn_files(spark, path)  # two payloads hold the separator
    assert read_back(spark, path) == expected(PAGES, least)
    payloads = {bytes(r.payload) for r in warc.read_records(spark, path).where("type = 'response'").collect()}
    assert payloads == {(html or "").encode() for _, _, html in PAGES}
    assert warc.read_records(spark, path, payload=False).where("payload IS NOT NULL").isEmpty()
    links = [r.url for r in warc.read_records(spark, path).where("type = 'request'").collect()]
    assert "http://e.example/a%20b%20%20Evil:%201" in links and None in links


def test_without_separator_no_file_is_read_whole(spark, tmp_path):
    pages = [p for p in PAGES if "WARC" not in (p[2] or "")]
    warc.write_archives(spark.createDataFrame(pages, SCHEMA), str(tmp_path / "a"))
    assert warc.torn_files(spark, str(tmp_path / "a")) == []
    assert read_back(spark, str(tmp_path / "a")) == expected(pages)


def test_no_pages(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "a"))
    assert warc.assemble(warc.read_records(spark, str(tmp_path / "a"))).collect() == []


def record(kind, rid, block=b"", version=b"WARC/1.0", content="application/http; msgtype=response", **headers):
    lines = [version, b"warc-type: " + kind.encode(), b"WARC-Record-ID: " + rid.encode(), b"Content-Type: " + content.encode()]
    lines += [f"{k.replace('_', '-')}: {v}".encode() for k, vs in headers.items() for v in (vs if isinstance(vs, list) else [vs])]
    return b"\r\n".join([*lines, b"Content-Length: " + str(len(block)).encode(), b"", block]) + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nX-Folded: a\r\n b\r\nContent-Length: 3\r\n\r\nabc"


def foreign():
    return [
        record("warcinfo", "<i>", b"software: x\r\n", content="application/warc-fields"),
        record("response", "<r1>", HTTP, WARC_Concurrent_To=["<q1>", "<m9>"], WARC_Payload_Digest="sha1:" + digest(b"abc")),  # names its request
        record("request", "<q1>", b"GET / HTTP/1.0\r\n\r\n", content="application/http; msgtype=request"),
        record("metadata", "<m1>", b"hops: L\r\n", content="application/warc-fields", WARC_Concurrent_To="<q1>"),  # through its request
        record("metadata", "<m0>", b"hops: E\r\n", content="application/warc-fields", WARC_Concurrent_To="<m1>"),
        record("response", "<r2>", HTTP, version=b"WARC/1.1", WARC_Payload_Digest="sha1:" + digest(b"other")),  # damaged
        record("request", "<q3>", b"", WARC_Concurrent_To="<gone>"),
        record("metadata", "<m3>", b"", WARC_Concurrent_To="<gone>"),
        record("request", "<q4>", b""),
        record("resource", "<s>", b"\x00\xff raw", content="image/png"),
        record("response", "<r2>", HTTP, version=b"WARC/1.1", WARC_Payload_Digest="sha1:" + digest(b"other")),
    ]


@pytest.mark.parametrize("how", ["plain", "one member", "a member each", "torn"])
def test_foreign_archives(spark, tmp_path, how):
    records = foreign() + ([record("resource", "<t>", b"x WARC/1.0\r\ny", content="text/plain")] if how == "torn" else [])
    data = b"".join(gzip.compress(r) if how != "one member" else r for r in records) if how != "plain" else b"".join(records)
    data = gzip.compress(data) if how == "one member" else data
    (tmp_path / ("a.warc" if how == "plain" else "a.warc.gz")).write_bytes(data)
    read = warc.read_records(spark, str(tmp_path))
    assert read.count() == len(records)
    rows = {r.id: r for r in warc.assemble(read).collect()}
    assert set(rows) == {"<r1>", "<r2>", "<gone>", "<q4>", "<s>"} | ({"<t>"} if how == "torn" else set())
    first = rows["<r1>"]
    assert (first.request.id, first.metadata.id, first.n_sides, first.capture.fields["x-folded"], bytes(first.capture.payload)) == ("<q1>", "<m0>", 3, "a b", b"abc")
    assert first.capture.intact and not rows["<r2>"].capture.intact
    gone = rows["<gone>"]
    assert (gone.capture, gone.request.id, gone.metadata.id) == (None, "<q3>", "<m3>")
    assert rows["<q4>"].request.id == "<q4>" and bytes(rows["<s>"].capture.payload) == b"\x00\xff raw"


def test_small_splits_read_the_same(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"".join(record("resource", f"<{k}>", b"z" * (37 * k % 911), content="text/plain") for k in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        read = warc.read_records(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 8
        assert {(r.id, r.payload_bytes) for r in read.collect()} == {(f"<{k}>", 37 * k % 911) for k in range(400)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_cut_off_record_is_an_error(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record("resource", "<a>", b"abc") + record("resource", "<b>", b"abcdef")[:-8])
    with pytest.raises(Exception, match="cut off"):
        warc.read_records(spark, str(tmp_path)).collect()


def test_repeated_links_end(spark):
    rows = [("<a>", "request", ["<b>"]), ("<b>", "metadata", ["<a>"]), (None, None, None)]
    records = spark.createDataFrame(rows, "id string, type string, concurrent_to array<string>")
    out = {r.id: r for r in warc.assemble(records).collect()}
    assert {out["<b>"].request.id, out["<a>"].metadata.id} == {"<a>", "<b>"} and len(out) == 3
