import base64
import gzip
import hashlib
import random
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest

from tallyloom.llm import warc


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def read_back(data):
    """(fields by lower-case name, block) of each record, by a reader of its own."""
    out = []
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        out.append(({k.lower(): v for k, v in fields.items()}, data[:n]))
        assert data[n : n + 4] == b"\r\n\r\n"
        data = data[n + 4 :]
    return out


def response(name, block, **more):
    return warc.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Target-URI", f"http://e.x/{name}/p"), ("WARC-Date", "2020-01-01T00:00:00Z"), *more.items()], block)


def test_round_trip_of_files(spark, tmp_path):
    html = "<html><head><title>A &amp; B</title></head><body><p>Hi <b>there</b></p><a href='/x?a=1&amp;b=2'>go</a><img src=\"i.png\"></body></html>".encode()
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(html[i : i + 40]), html[i : i + 40]) for i in range(0, len(html), 40)) + b"0\r\n\r\n"
    heads = {"plain": (b"", html), "chunked": (b"Transfer-Encoding: chunked\r\n", chunked), "gzip": (b"Content-Encoding: gzip\r\n", gzip.compress(html)), "broken": (b"Content-Encoding: gzip\r\n", b"no gzip")}
    data = warc.record_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:0>")], b"software: x")
    for name, (head, body) in heads.items():
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Long: a\r\n b\r\n" + head + b"\r\n" + body
        data += warc.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Target-URI", f"http://e.x/{name}/p"), ("WARC-Date", "2020-01-01T00:00:00Z")], block)
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(warc.record_bytes([(k, v) for k, v in f.items() if k != "content-length"], b)) for f, b in read_back(data)))
    responses = warc.read_responses(spark, str(tmp_path))
    assert responses.count() == 8
    rows = [r.asDict() for r in warc.derive(responses).collect()]
    assert len(rows) == 16
    back = read_back(b"".join(warc.as_bytes(r) for r in rows))
    assert len(back) == 16
    for (fields, block), r in zip(back, rows, strict=True):
        assert fields["warc-refers-to"] == r["refers_to"] and fields["warc-record-id"] == r["record_id"] and fields["warc-block-digest"] == sha(block) == r["block_digest"]
        assert int(fields["content-length"]) == len(block) == r["content_length"]
    for name in ("plain", "chunked", "gzip"):
        meta, text = ([r for r in rows if r["refers_to"] == f"<urn:uuid:{name}>" and r["warc_type"] == t][0]["block"] for t in ("metadata", "conversion"))
        assert text == "Hi there\ngo" or text.split() == ["Hi", "there", "go"]
        assert "title: A & B\r\n" in meta and "http-status: 200\r\n" in meta and "http-header-x-long: a b\r\n" in meta
        assert f"outlink: http://e.x/x?a=1&b=2 L a/@href\r\n" in meta and f"outlink: http://e.x/{name}/i.png E img/@src\r\n" in meta
        assert f"source-payload-digest: {sha(heads[name][1])}\r\n" in meta


def test_edges(spark):
    schema = "record_id string, target_uri string, warc_date string, block binary, kept_ int"
    df = spark.createDataFrame([(None, None, None, None, 1), ("<a>", "http://[bad", "d", b"HTTP/1.1 404\r\n\r\n<a href='http://[x'>t</a>", 1), ("<a>", "u", "d", b"no http", 2)], schema)
    rows = warc.derive(df, keep="kept_").collect()
    assert len(rows) == 6 and all(r.refers_to for r in rows) and warc.derive(df.limit(0)).count() == 0
    assert sorted(r.block for r in rows if r.warc_type == "conversion") == ["", "", "t"]


def test_pages(spark):
    d = "/root/testdata/sf0.001"
    pages = {r.page_id: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    rows = warc.op4_warc_derivatives(spark, d).collect()
    assert sorted((r.page_id, r.warc_type) for r in rows) == sorted((p, t) for p in pages for t in ("metadata", "conversion"))
    assert len({r.record_id for r in rows}) == len(rows) and len({r.refers_to for r in rows}) == len(pages)
    for r in rows:
        assert r.source_payload_digest == sha((pages[r.page_id].html or "").encode()) and r.block_digest == sha(r.block.encode())


def test_headers_and_digests_of_the_source_are_kept_in_both_records(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nServer: s/1\r\n\r\nhello"
    (tmp_path / "a.warc").write_bytes(response("x", block, **{"WARC-IP-Address": "10.0.0.1", "WARC-Payload-Digest": "sha1:GIVENPAYLOAD", "WARC-Block-Digest": "sha1:GIVENBLOCK"}) + response("y", block))
    rows = [r.asDict() for r in warc.derive(warc.read_responses(spark, str(tmp_path))).collect()]
    for r in rows:
        given = r["refers_to"] == "<urn:uuid:x>"
        want = ("sha1:GIVENBLOCK", "sha1:GIVENPAYLOAD") if given else (sha(block), sha(b"hello"))
        assert (r["source_block_digest"], r["source_payload_digest"]) == want
        heads = {h["name"]: h["value"] for h in r["source_headers"]}
        assert heads["http-header-server"] == "s/1" and heads["warc-header-warc-date"] == "2020-01-01T00:00:00Z" and heads.get("warc-header-warc-ip-address") == ("10.0.0.1" if given else None)
        fields, body = read_back(warc.as_bytes(r))[0]
        assert (fields["source-block-digest"], fields["source-payload-digest"], fields["warc-refers-to"]) == (*want, r["refers_to"])
        if r["warc_type"] == "metadata":
            assert f"source-payload-digest: {want[1]}\r\n".encode() in body and b"http-header-server: s/1\r\n" in body and (b"warc-header-warc-ip-address: 10.0.0.1" in body) == given
        else:
            assert body == b"hello" and fields["source-http-header-server"] == "s/1"


def test_broken_files_give_what_can_be_read(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\n"
    inner = block + b"before\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\nafter"
    good = [response("a", block + b"one"), response("b", inner), response("c", block + b"three")]
    (tmp_path / "bytes_after.warc.gz").write_bytes(b"".join(map(gzip.compress, good)) + b"no gzip at all")
    (tmp_path / "breaks_off.warc.gz").write_bytes(b"".join(map(gzip.compress, good[:2])) + gzip.compress(good[2])[:-20])
    (tmp_path / "bad_length.warc").write_bytes(good[0] + good[1].replace(b"Content-Length: ", b"Content-Length: x") + good[2])
    (tmp_path / "cut_short.warc").write_bytes(good[0] + good[1] + good[2][:-9])
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = {}
    for f in sorted(tmp_path.iterdir()):
        rows[f.name] = [(r.record_id[10:-1] if r.record_id else None, r.block, r.error) for r in warc.read_responses(spark, str(f)).collect()]
    whole = [("a", block + b"one", None), ("b", inner, None), ("c", block + b"three", None)]
    for name in ("bytes_after.warc.gz", "breaks_off.warc.gz"):
        assert rows[name][:2] == whole[:2] and rows[name][2][2] and len(rows[name]) == 3
    assert [r for r in rows["bad_length.warc"] if not r[2]][0] == whole[0] and any("Content-Length" in (r[2] or "") for r in rows["bad_length.warc"]) and whole[2] in rows["bad_length.warc"]
    assert rows["cut_short.warc"][:2] == whole[:2] and "cut short" in rows["cut_short.warc"][2][2]
    assert rows["empty.warc"] == []
    assert warc.derive(warc.read_responses(spark, str(tmp_path))).count() > 0


def test_plain_files_are_read_in_splits(spark, tmp_path):
    rng = random.Random(1)
    blocks = [b"HTTP/1.1 200 OK\r\n\r\n" + rng.randbytes(rng.randint(0, 3000)) for _ in range(200)]
    (tmp_path / "a.warc").write_bytes(b"".join(response(str(i), b) for i, b in enumerate(blocks)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = warc.read_responses(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 5
        assert sorted((int(r.record_id[10:-1]), bytes(r.block), r.error) for r in df.collect()) == [(i, b, None) for i, b in enumerate(blocks)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("split", [4000, 20_000, 60_000, 10_000_000])
def test_records_that_quote_records_reach_over_splits(spark, tmp_path, split):
    quoted = b"\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc"
    named = response("inner", b"HTTP/1.1 200 OK\r\n\r\nx")
    blocks = [b"HTTP/1.1 200 OK\r\n\r\n" + bytes([65 + i]) * (500 * i) + (quoted * 100 + named * 20) * 3 for i in range(8)]
    (tmp_path / "a.warc").write_bytes(b"".join(response(str(i), b) for i, b in enumerate(blocks)))
    (tmp_path / "b.warc").write_bytes(b"".join(response(str(i + 10), b[:900]) for i, b in enumerate(blocks)))
    # A length that the file doesn't hold spoils its own split at most.
    (tmp_path / "c.warc").write_bytes(response("20", b"x" * 50).replace(b"Length: 50", b"Length: 99999999") + response("21", b"y" * 9000) + b"".join(response(str(i), b"z" * 9000) for i in range(22, 32)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        rows = warc.read_responses(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = {int(r.record_id[10:-1]): bytes(r.block) for r in rows if r.error is None}
    assert {k: v for k, v in whole.items() if k < 20} == {**dict(enumerate(blocks)), **{i + 10: b[:900] for i, b in enumerate(blocks)}}
    assert all(r.error is None for r in rows if r.record_id is None or int(r.record_id[10:-1]) < 20)
    broken = [r for r in rows if r.error is not None]
    assert len(broken) == 1 and (split > 100_000 or {30, 31} <= set(whole))


class Reader(HTMLParser):
    """Words, links and title of a page, read by the standard library."""

    def __init__(self, base):
        super().__init__(convert_charrefs=True)
        self.base, self.words, self.links, self.title, self.quiet, self.in_title = base, [], [], [], 0, False

    def handle_starttag(self, tag, attributes):
        self.quiet += tag in ("script", "style")
        self.in_title |= tag == "title"
        for k, v in attributes:
            if (tag, k) in (("a", "href"), ("img", "src"), ("link", "href"), ("script", "src")) and v is not None:
                self.links.append(" ".join(urljoin(self.base, v.strip()).split()))

    def handle_endtag(self, tag):
        self.quiet -= tag in ("script", "style") and self.quiet > 0
        if tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.quiet:
            self.words.append(data)


@pytest.mark.parametrize("size", ["sf0.01"])
def test_pages_equal_another_parser_s_reading(spark, size):
    d = f"/root/testdata/{size}"
    pages = {r.page_id: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    for r in warc.op4_warc_derivatives(spark, d).collect():
        p = pages[r.page_id]
        reader = Reader(p.url)
        reader.feed(p.html or "")
        reader.close()
        if r.warc_type == "conversion":
            assert "".join(r.block.split()) == "".join("".join(reader.words).split())
        else:
            lines = [line.split(": ", 1) for line in r.block.split("\r\n")[:-1]]
            assert [v.rsplit(" ", 2)[0] for k, v in lines if k == "outlink"] == reader.links
            assert [v for k, v in lines if k == "title"] == ([" ".join("".join(reader.title).split())] if p.html else [])
            assert ("http-status", "200") in map(tuple, lines) and ("source-payload-digest", sha((p.html or "").encode())) in map(tuple, lines)


def test_very_long_pages(spark):
    page = "<p>" + "word " * 400_000 + "</p>" + "<a href=/x>l</a>" * 20_000
    df = spark.createDataFrame([(1, "http://e.x/", page), (1, "http://e.x/", page), (2, None, None)], "page_id long, url string, html string")
    rows = warc.derive(warc.responses_from_pages(df), keep="page_id").collect()
    long = [r for r in rows if r.page_id == 1 and r.warc_type == "conversion"]
    assert len(rows) == 6 and len(long) == 2 and long[0].record_id == long[1].record_id and long[0].block.count("word") == 400_000
    assert all(r.block.count("outlink") == 20_000 for r in rows if r.page_id == 1 and r.warc_type == "metadata")
