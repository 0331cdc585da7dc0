"""Legacy archives, their conversion and the way back."""

import base64
import gzip
import hashlib

import pytest

from kinloom.llm import warc

SCHEMA = "page_id long, url string, html string"


def contract(table):
    order = sorted(table, key=lambda r: (r[0] is None, r[0] or 0))
    first, out = {}, []
    for number, _, html in order:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((number, len(body), digest, "revisit" if body in first else "response", first.get(body)))
        first.setdefault(body, number)
    return sorted(out, key=str)


def run(spark, table, schema=SCHEMA):
    rows = warc.archive_pages(spark.createDataFrame(table, schema))
    return sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in rows.collect()), key=str)


def test_edges(spark):
    long = "<p>é " + "x" * 9_000_000
    table = [
        (7, "http://a.test/ b\n", "<p>same"), (3, None, "<p>same"), (9, "http://c.test", "<p>same"), (5, "u", None), (4, "", ""), (None, "n", ""),
        (1, "http://l.test", long), (2, "http://l.test/2", long), (11, "w", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\nfiledesc://x"), (12, "z", "\r\n\r\n"), (13, "z", "HTTP/1.1 200 OK\r\n\r\nnested"), (14, "é ü", "ü\x00\n"),
        (15, "twice", "twice"), (15, "twice", "twice"),
    ]
    assert run(spark, table) == contract(table)


def test_many_equal(spark):
    table = [(k, f"http://h.test/{k}", "equal" if k % 3 else f"own {k}") for k in range(2000)]
    assert run(spark, table) == contract(table)


def test_empty_and_clashing(spark):
    assert run(spark, []) == []
    rows = spark.createDataFrame([(1, "u", "h", "x", "y")], "page_id long, url string, html string, content string, at string")
    assert [r["record_type"] for r in warc.archive_pages(rows).collect()] == ["response"]


def test_small_payloads_are_no_revisits(spark):
    rows = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], SCHEMA)
    found = {r["page_id"]: r["record_type"] for r in warc.archive_pages(rows, min_bytes=3).collect()}
    assert found == {1: "response", 2: "response", 3: "response", 4: "revisit"}


V1 = b"filedesc://old.arc 0.0.0.0 19970101120000 text/plain 76\n1 0 Archive\nURL IP-address Archive-date Content-type Archive-length\n\n\n"
V1 = V1.replace(b" 76\n", b" %d\n" % (len(V1) - V1.index(b"\n") - 3))


def test_version_1_with_spaces_and_short_dates():
    body = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\nhello\n"
    data = V1 + b"http://a.test/a b c 1.2.3.4 1997 text/html %d\n" % len(body) + body + b"\n" + b"dns:a.test 1.2.3.4 19970102030405 text/dns 4\nabcd\n"
    records = list(warc.arc_records(data))
    assert [r[2]["url"] for r in records] == ["filedesc://old.arc", "http://a.test/a b c", "dns:a.test"]
    assert records[1][3] == body and records[2][3] == b"abcd"
    assert warc.warc_date("1997") == "1997-01-01T00:00:00Z" and warc.warc_date("19970102030405") == "1997-01-02T03:04:05Z"


def test_version_2_fields():
    head = b"2 0 Archive\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    data = b"filedesc://n.arc 0.0.0.0 20010101000000 text/plain 200 - - 0 n.arc %d\n" % len(head) + head + b"\nhttp://b.test 9.9.9.9 20010203040506 text/html 404 abc http://c.test 77 n.arc 3\nxyz\n"
    (_, _, first, _), (_, version, found, block) = warc.arc_records(data)
    assert (first["length"], version, found["status"], found["location"], block) == (str(len(head)), 2, "404", "http://c.test", b"xyz")


def test_broken_archives():
    with pytest.raises(ValueError):
        list(warc.arc_records(b"no header line\n"))
    with pytest.raises(ValueError):
        list(warc.warc_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"))
    assert list(warc.arc_records(b"")) == [] and list(warc.warc_records(b"")) == []


def test_files_are_warc(spark, tmp_path):
    """What convert writes: whole records, synthesised fields, types and a lasting identifier."""
    arc, out, again = (str(tmp_path / x) for x in ("arc", "warc", "again"))
    warc.write_arc(spark.createDataFrame([(1, "http://a.test", "<p>x"), (2, "http://b.test", "<p>x"), (3, "http://c.test", "<p>y")], SCHEMA).coalesce(1), arc)
    legacy = list((tmp_path / "arc").glob("*.gz"))
    assert len(legacy) == 1 and gzip.decompress(legacy[0].read_bytes()).startswith(b"filedesc://")
    warc.convert(spark, arc, out)
    warc.convert(spark, arc, again)
    data = gzip.decompress(next((tmp_path / "warc").glob("*.gz")).read_bytes())
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
    records = [h for _, h, _ in warc.warc_records(data)]
    assert sorted(h["WARC-Type"] for h in records) == ["response", "response", "revisit", "warcinfo"]
    by_uri = {h.get("WARC-Target-URI"): h for h in records}
    one, two = by_uri["http://a.test"], by_uri["http://b.test"]
    assert two["WARC-Refers-To"] == one["WARC-Record-ID"] and two["WARC-Refers-To-Target-URI"] == "http://a.test"
    assert one["WARC-Date"] == "2024-01-01T00:00:00Z" and one["WARC-Payload-Digest"] == two["WARC-Payload-Digest"] == f"sha1:{warc.base32_sha1(b'<p>x')}"
    both = [{r["headers"]["WARC-Record-ID"] for r in warc.read_warc(spark, p).collect()} for p in (out, again)]
    assert both[0] == both[1] and len(both[0]) == 4
    kinds = {r["url"]: (r["type"], r["version"]) for r in warc.read_arc(spark, arc).collect()}
    assert kinds["http://a.test"][0] == "response"
