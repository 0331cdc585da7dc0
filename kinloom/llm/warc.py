"""Legacy web archives to WARC, and back to rows."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinloom.llm.common import release_memory
from kinloom.operators.recovery import checkpointed, fresh_folder

#: Bytes of records in one archive; a longer record is an archive of its own.
ARCHIVE_BYTES = 4 << 20
#: Fields of a URL record's line, from the right, by version of the archive.
ARC_FIELDS = {
    1: ["ip", "date", "mime", "length"],
    2: ["ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"],
}
ARC_LINES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: WARC's version line and the profile of revisits.
WARC_VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARC_RECORDS = (
    "archive string, at long, version int, record_id string, url string, ip string, date string, mime string, "
    "type string, payload_bytes long, payload_digest string, block_digest string, http string, block binary"
)
WARC_RECORDS = "archive string, at long, headers map<string,string>, http string, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _token(text: str) -> str:
    """A URL as one field of a line: white space and control characters as percent codes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text) or "-"


def _split_http(block: bytes) -> int:
    """Where the payload begins: behind the headers of an HTTP response, else at 0."""
    if not block.startswith(b"HTTP/"):
        return 0
    end = re.search(rb"\r?\n\r?\n", block)
    return end.end() if end else len(block)


def _inflated(content: bytes) -> bytes:
    """An archive's bytes, out of one or more gzip members where it has them."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(content) + member.flush())
        content = member.unused_data
    return b"".join(out)


# ------------------------------------------------------------- legacy archives
def _arc_line(version: int, url: str, ip: str, date: str, mime: str, length: int, at: int, name: str, status: str, checksum: str) -> bytes:
    more = f" {status} {checksum} - {at} {name}" if version == 2 else ""
    return f"{url} {ip} {date} {mime}{more} {length}\n".encode()


def _arc_writer(date: str):
    """Pages to the bytes of legacy archives; versions 1 and 2 in turn."""

    def version_block(version: int, name: str) -> bytes:
        body = f"{version} 0 kinloom\n{ARC_LINES[version]}\n".encode()
        return _arc_line(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(body), 0, name, "200", "-") + body + b"\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, count, version, name = [], 0, 0, 1, ""
        for batch in batches:
            for number, url, html in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary())):
                body = html.as_py() or b""
                named = f"X-Page-Id: {number.as_py()}\r\n" if number.is_valid else ""
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {len(body)}\r\n\r\n".encode() + body
                if held and size + len(block) > ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["content"])
                    held, size = [], 0
                if not held:
                    version, name = 1 + count % 2, f"{uuid.uuid4().hex}.arc"
                    held.append(version_block(version, name))
                    size, count = len(held[0]), count + 1
                line = _arc_line(version, _token(url.as_py() or "-"), "0.0.0.0", date, "text/html", len(block), size, name, "200", base32_sha1(body))
                held += [line, block, b"\n"]
                size += len(line) + len(block) + 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["content"])
        release_memory()

    return run


def _save(archives: DataFrame, path: str, end: str) -> None:
    """Each row's bytes, and ``end`` behind them, as a gzip file of its own."""
    writer = archives.select(F.col("content").cast("string").alias("value")).write.option("lineSep", end).option("maxRecordsPerFile", 1)
    writer.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20240101000000") -> None:
    """Legacy archives of pages as HTTP responses, in files of about ``ARCHIVE_BYTES``.

    The id goes into the response as ``X-Page-Id``; a null id is left out, a
    null URL is ``-``, a null html is empty.  The last newline of the last
    record is the file's end.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    _save(rows.mapInArrow(_arc_writer(date), "content binary"), path, "\n")


def arc_records(data: bytes) -> Iterator[tuple[int, int, dict, bytes]]:
    """(place, version, fields, block) of each record of a legacy archive, version blocks included.

    A line's fields are taken from its right end, as old URLs may hold spaces.
    The version block says which fields follow; its own line is read as that
    version's where it has as many fields, else as version 1's.  A record whose
    declared length passes the end keeps the bytes that are there.
    """
    at, version = 0, 1
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].rstrip(b"\r").decode("utf-8", "replace")
        if not line.strip():
            at = end + 1
            continue
        if line.startswith("filedesc://"):
            version = 2 if data[end + 1 : end + 2] == b"2" and line.count(" ") >= len(ARC_FIELDS[2]) else 1
        fields = line.rsplit(" ", len(ARC_FIELDS[version]))
        if len(fields) <= len(ARC_FIELDS[version]) or not fields[-1].isdigit():
            raise ValueError(f"no header line of version {version} at {at}: {line[:80]!r}")
        found = dict(zip(["url", *ARC_FIELDS[version]], fields))
        start = end + 1
        stop = min(start + int(found["length"]), len(data))
        said = version
        if line.startswith("filedesc://") and data[start : start + 1].isdigit():
            said = 2 if data[start : start + 1] == b"2" else 1
        yield at, version, found, data[start:stop]
        version, at = said, stop


def _arc_reader(blocks: bool):
    names = [f.split()[0] for f in ARC_RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                path, rows = path.as_py(), []
                file = path.rsplit("/", 1)[-1]
                for at, version, found, block in arc_records(_inflated(content.as_py())):
                    start = _split_http(block)
                    kind = "warcinfo" if found["url"].startswith("filedesc://") else "response" if start else "resource"
                    payload = block[start:]
                    digest = base32_sha1(payload)
                    number = uuid.uuid5(uuid.NAMESPACE_URL, f"{file}#{at}")
                    rows.append((path, at, version, f"<urn:uuid:{number}>", found["url"], found["ip"], warc_date(found["date"]), found["mime"], kind, len(payload), digest, base32_sha1(block) if blocks else None, block[:start].decode("utf-8", "replace"), block if blocks else None))
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.string()] * 6, pa.int64(), *[pa.string()] * 3, pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        release_memory()

    return run


def warc_date(date: str) -> str:
    """14 digits (or the 12, 10, 8 ... of older archives) as WARC's timestamp; what is missing is the least."""
    digits = (date if date.isdigit() else "")[:14]
    digits += "00000101000000"[len(digits) :]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of legacy archives with what WARC asks of them (``ARC_RECORDS``)."""
    return _files(spark, path).mapInArrow(_arc_reader(True), ARC_RECORDS)


# ------------------------------------------------------------------------ WARC
def _warc_head(kind: str, record_id: str, date: str, length: int, fields: list[tuple[str, str]]) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *fields, ("Content-Length", str(length))]
    return WARC_VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n"


def _warc_writer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Legacy archives, and what each one's revisits repeat, to the bytes of WARC archives.

    An archive ends without the two line ends behind its last record.
    """
    for batch in batches:
        for path, content, revisits in zip(batch.column(0), batch.column(1), batch.column(2)):
            file = path.as_py().rsplit("/", 1)[-1]
            repeats = {x["at"]: x for x in revisits.as_py() or ()}
            out = []
            for at, version, found, block in arc_records(_inflated(content.as_py())):
                number = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{at}')}>"
                start, date = _split_http(block), warc_date(found["date"])
                if found["url"].startswith("filedesc://"):
                    info = f"software: kinloom\r\nformat: WARC file version 1.1\r\nconverted-from: ARC version {version}\r\nisPartOf: {found['url'][11:]}\r\n".encode()
                    out.append(_warc_head("warcinfo", number, date, len(info), [("WARC-Filename", file), ("Content-Type", "application/warc-fields")]) + info)
                    continue
                digest = f"sha1:{base32_sha1(block[start:])}"
                fields = [("WARC-Target-URI", found["url"]), ("WARC-IP-Address", found["ip"]), ("WARC-Payload-Digest", digest)]
                if start:
                    fields.append(("Content-Type", "application/http; msgtype=response"))
                else:
                    fields.append(("Content-Type", found["mime"]))
                kind = "response" if start else "resource"
                if again := repeats.get(at):
                    kind, block = "revisit", block[:start]
                    fields += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", again["refers_to"]), ("WARC-Refers-To-Target-URI", again["uri"]), ("WARC-Refers-To-Date", again["date"])]
                fields.append(("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"))
                out.append(_warc_head(kind, number, date, len(block), fields) + block)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(out)], pa.binary())], ["content"])
    release_memory()


def warc_records(data: bytes) -> Iterator[tuple[int, dict, bytes]]:
    """(place, headers, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = dict(x.split(": ", 1) for x in lines if ": " in x)
        start = end + 4
        stop = start + int(headers["Content-Length"])
        if stop > len(data):
            raise ValueError(f"record at {at} ends before its declared length")
        yield at, headers, data[start:stop]
        at = stop


def _warc_reader(payloads: bool):
    names = [f.split()[0] for f in WARC_RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for at, headers, block in warc_records(_inflated(content.as_py())):
                    if headers.get("WARC-Block-Digest", "").removeprefix("sha1:") not in ("", base32_sha1(block)):
                        raise ValueError(f"block digest differs at {at} of {path.as_py()}")
                    start = _split_http(block)
                    payload, whole = block[start:], headers["WARC-Type"] in ("response", "resource")
                    digest = base32_sha1(payload) if whole else None
                    if whole and headers.get("WARC-Payload-Digest", f"sha1:{digest}") != f"sha1:{digest}":
                        raise ValueError(f"payload digest differs at {at} of {path.as_py()}")
                    rows.append((path.as_py(), at, list(headers.items()), block[:start].decode("utf-8", "replace"), len(payload) if whole else None, digest, payload if payloads and whole else None))
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int64(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        release_memory()

    return run


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of WARC archives (``WARC_RECORDS``); digests are checked, and what does not agree is an error."""
    return _files(spark, path).mapInArrow(_warc_reader(payloads), WARC_RECORDS)


def page_id(http: Column) -> Column:
    """The id that :func:`write_arc` put into a response, or null."""
    found = F.regexp_extract(http, r"(?m)^X-Page-Id: (-?\d+)\r?$", 1)
    return F.when(found != "", found.cast("long"))


def revisits(records: DataFrame, order: list[Column], min_bytes: int = 0) -> DataFrame:
    """(archive, at, refers_to, uri, date) of responses whose payload an earlier one in ``order`` holds.

    One row for each payload is found by minima before the shuffle and joined
    back, a join that skew handling may split; payloads themselves stay where
    they are.
    """
    held = records.where((F.col("type") == "response") & (F.col("payload_bytes") >= min_bytes))
    held = held.select("payload_digest", "payload_bytes", "archive", "at", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "record_id", "url", "date").alias("who"))
    first = held.groupBy("payload_digest", "payload_bytes").agg(F.min("who").alias("first"), F.count("*").alias("many")).where("many > 1")
    again = held.join(checkpointed(first.drop("many")), ["payload_digest", "payload_bytes"]).where("who.record_id <> first.record_id")
    return again.select("archive", "at", F.col("first.record_id").alias("refers_to"), F.col("first.url").alias("uri"), F.col("first.date").alias("date"))


def convert(spark: SparkSession, arc: str, warc: str, min_bytes: int = 0) -> None:
    """Legacy archives in folder ``arc`` to WARC archives in folder ``warc``, one for one.

    Header lines of version 1 or 2 and declared lengths give the records.
    Identifiers are UUIDs of the file's name and the record's place, so
    converting again gives the same; timestamps, types (warcinfo for version
    blocks, response for HTTP, else resource) and SHA-1 digests are made anew.
    Of HTTP responses with equal payloads of ``min_bytes`` or more, the one
    with the smallest page id (nulls last) keeps its payload and the others
    become revisits of it.

    The archives are read twice: for identifiers and digests, and, once the
    revisits are known, for the records.  Only whole, compressed archives are
    shuffled, never loose payloads; a task holds one archive.
    """
    files = _files(spark, arc)
    seen = checkpointed(files.mapInArrow(_arc_reader(False), ARC_RECORDS).drop("block", "block_digest").withColumn("page", page_id(F.col("http"))).drop("http"))
    again = revisits(seen, [F.col("page").isNull(), F.col("page"), F.col("archive"), F.col("at")], min_bytes)
    again = again.groupBy("archive").agg(F.collect_list(F.struct("at", "refers_to", "uri", "date")).alias("revisits"))
    joined = files.join(again, F.col("path") == F.col("archive"), "left").select("path", "content", "revisits")
    _save(joined.mapInArrow(_warc_writer, "content binary"), warc, "\r\n\r\n")


def page_records(spark: SparkSession, warc: str) -> DataFrame:
    """Per page of a converted archive: its payload's size and digest, its record's type, and the page it revisits.

    Size and digest of a revisit are those of the record it refers to.
    """
    rows = read_warc(spark, warc, payloads=False)
    rows = checkpointed(
        rows.where("headers['WARC-Type'] in ('response', 'revisit')").select(
            page_id(F.col("http")).alias("page_id"),
            F.col("headers")["WARC-Type"].alias("record_type"),
            F.col("headers")["WARC-Record-ID"].alias("id"),
            F.col("headers")["WARC-Refers-To"].alias("to"),
            "payload_bytes",
            "payload_digest",
        )
    )
    whole = rows.where("record_type = 'response'")
    again = rows.where("record_type = 'revisit'").select("page_id", "record_type", "to")
    aims = whole.select(F.col("id").alias("to"), "payload_bytes", "payload_digest", F.col("page_id").alias("refers_to"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return whole.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(again.join(aims, "to", "left").select(*columns))


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Pages written as legacy archives, converted to WARC, read back (:func:`page_records`).

    Null html: an empty payload, as equal to others as any.  Null id: a record
    without id, last in the order.  Rows that repeat an id are records of their
    own; of equal payloads one is the response.  Html and URLs of any length
    are whole; other columns are not read; an empty table gives an empty one.
    """
    spark = pages.sparkSession
    arc, warc = fresh_folder(spark), fresh_folder(spark)
    write_arc(pages, arc, id_col, url_col, html_col)
    convert(spark, arc, warc, min_bytes)
    return page_records(spark, warc)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, strlen(h) AS payload_bytes, upper(sha1(h)) AS x,
  row_number() OVER same AS place, first(page_id) OVER same AS least FROM p WINDOW same AS (PARTITION BY h ORDER BY page_id NULLS LAST)),
b AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(x, 1 + 5 * i, 5))::BIGINT) AS parts FROM d)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((parts[1 + k // 4] >> (15 - 5 * (k % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN least END AS refers_to
FROM b
"""
