"""Media columns: Ogg streams written and read back, in numpy and zlib.

A stream holds two logical streams, interleaved by page: the samples, 8-bit
unsigned mono PCM in packets of eight blocks of 576, and an index with one
packet for every page's worth of samples.  Granule positions count samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinloom.llm.common import intake, outgo

RATE = 8000
BLOCK = 576
PACKET = 8 * BLOCK
#: Fixed values of the format.
CAPTURE, CONTINUED, FIRST, LAST, NO_PACKET_ENDS = b"OggS", 1, 2, 4, 0xFFFFFFFFFFFFFFFF
SEGMENTS = 255
SAMPLES, INDEX = 1, 2
#: A byte's bits in reverse, to have zlib's reflected CRC compute Ogg's.
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """A stream that breaks the format: bad checksum, lost page, unfinished packet."""


def checksum(page: bytes) -> int:
    """Ogg's CRC-32 (generator 0x04C11DB7, not reflected, from 0) of a page with its field zeroed."""
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def lacing(size: int) -> bytes:
    """A packet's lacing values: 255s and a last one below."""
    return b"\xff" * (size // 255) + bytes((size % 255,))


class _Writer:
    """Pages of one logical stream."""

    def __init__(self, serial: int):
        self.serial, self.sequence, self.values, self.body = serial, 0, bytearray(), bytearray()
        self.granule, self.ended, self.continued = 0, False, False

    def page(self, flags: int) -> bytes:
        """The values and bytes gathered so far (one page's at most) as a page."""
        values = bytes(self.values[:SEGMENTS])
        size = sum(values)
        flags |= CONTINUED if self.continued else 0
        granule = self.granule if self.ended else NO_PACKET_ENDS
        head = struct.pack("<4sBBQIIIB", CAPTURE, 0, flags, granule, self.serial, self.sequence, 0, len(values))
        page = head + values + bytes(self.body[:size])
        page = page[:22] + struct.pack("<I", checksum(page)) + page[26:]
        self.continued = values[-1] == 255
        del self.values[: len(values)], self.body[:size]
        self.sequence += 1
        self.ended = False
        return page

    def add(self, packet: bytes, granule: int) -> Iterator[bytes]:
        """Yield the pages that fill while the packet is added."""
        more = lacing(len(packet))
        self.body += packet
        while len(self.values) + len(more) > SEGMENTS:
            room = SEGMENTS - len(self.values)
            self.values += more[:room]
            more = more[room:]
            yield self.page(0)
        self.values += more
        self.granule, self.ended = granule, True


def write_ogg(payload: bytes, rate: int = RATE) -> bytes:
    """The payload as a multiplexed Ogg stream."""
    samples, index = _Writer(SAMPLES), _Writer(INDEX)
    out = []
    for w, head in ((samples, struct.pack("<8sIBBQ", b"PCM8Mono", rate, 1, 8, len(payload))), (index, struct.pack("<8sI", b"PageIndx", PACKET))):
        out += w.add(head, 0)
        out.append(w.page(FIRST))
    for at in range(0, len(payload), PACKET):
        pages = list(samples.add(payload[at : at + PACKET], min(at + PACKET, len(payload))))
        if pages:
            out += pages
            out += index.add(struct.pack("<QI", at, samples.sequence), at)
    out += [samples.page(LAST)] if samples.values else []
    list(index.add(struct.pack("<QI", len(payload), samples.sequence), len(payload)))
    out.append(index.page(LAST))
    return b"".join(out)


def read_pages(data: bytes) -> Iterator[tuple]:
    """(flags, granule, serial, sequence, lacing values, body) of each page, checksums verified."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != CAPTURE or len(data) < at + 27:
            raise OggError(f"no page at byte {at}")
        _, _, flags, granule, serial, sequence, crc, count = struct.unpack_from("<4sBBQIIIB", data, at)
        values = data[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(values)
        page = data[at:end]
        if len(page) < end - at or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise OggError(f"bad checksum in the page at byte {at}")
        yield flags, granule, serial, sequence, values, page[27 + count :]
        at = end


def read_ogg(data: bytes) -> dict[int, list[tuple[bytes, int | None]]]:
    """Packets of each logical stream with the granule position known at their end.

    A granule belongs to the last packet that ends on its page; packets that end
    before it on the page get None.
    """
    packets: dict[int, list] = {}
    open_: dict[int, list[bytes]] = {}
    expect: dict[int, int] = {}
    for flags, granule, serial, sequence, values, body in read_pages(data):
        if sequence != expect.get(serial, 0) or bool(flags & FIRST) != (sequence == 0):
            raise OggError(f"page {sequence} of stream {serial} out of order")
        parts = open_.setdefault(serial, [])
        if bool(parts) != bool(flags & CONTINUED):
            raise OggError(f"page {sequence} of stream {serial} breaks a packet")
        expect[serial] = sequence + 1
        mine, at, size, before = packets.setdefault(serial, []), 0, 0, len(packets[serial])
        for v in values:
            size += v
            if v < 255:
                mine.append((b"".join((*parts, body[at : at + size])), None))
                parts.clear()
                at, size = at + size, 0
        if size or (values and values[-1] == 255):
            parts.append(body[at : at + size])
        if len(mine) > before and granule != NO_PACKET_ENDS:
            mine[-1] = mine[-1][0], granule
    if any(open_.values()):
        raise OggError("a packet is not finished")
    return packets


def timestamps(packets: list[tuple[bytes, int | None]], rate: int) -> list[float]:
    """Seconds at which each sample packet ends, counted back from the known granules."""
    out, ahead = [], None
    for packet, granule in reversed(packets):
        ahead = granule if granule is not None else ahead
        out.append(ahead / rate)
        ahead -= len(packet)
    return out[::-1]


def decode(data: bytes) -> tuple[bytes, str]:
    """The payload read back and its features."""
    streams = read_ogg(data)
    head, *body = streams[SAMPLES]
    _, rate, _, _, total = struct.unpack("<8sIBBQ", head[0])
    payload = b"".join(p for p, _ in body)
    if len(payload) != total:
        raise OggError(f"{len(payload)} samples of {total}")
    ends = timestamps(body, rate)
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    level = np.arange(256) - 128
    energy = int((counts * level.astype(np.int64) ** 2).sum())
    crossings = int(np.count_nonzero((x[1:] < 128) != (x[:-1] < 128)))
    blocks = x.reshape(-1, BLOCK).sum(1, dtype=np.int64)
    feature = f"packets={len(body)};index={len(streams[INDEX]) - 1};last_ms={round(1000 * ends[-1])};sum={int((counts * level).sum())};energy={energy};crossings={crossings};loudest={int(blocks.argmax())}"
    return payload, feature


def padded(raw: bytes) -> bytes:
    """The bytes with 255s up to a positive multiple of 576."""
    return raw + b"\xff" * (-len(raw) % BLOCK if raw else BLOCK)


def _write(text: pa.Array) -> pa.Array:
    return pa.array([write_ogg(padded(t.as_py() or b"")) for t in text.cast(pa.binary())], pa.binary())


def _read(media: pa.Array) -> pa.Array:
    rows = []
    for m in media:
        payload, feature = decode(m.as_py())
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), feature))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "feature"]
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def encode_media(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """Add a binary column with the Ogg stream of each whole text.

    Null and empty texts are 576 bytes of 255.  Nothing is shuffled; other
    columns stay whatever their names and nulls (one named like ``media_col``
    is replaced); equal texts, and so repeated rows, give equal streams; texts of
    any length are whole; no rows give no rows.
    """
    base, names = intake(docs, text_col)
    return outgo(base, names, {text_col: F.col("_w0"), media_col: F.arrow_udf(_write, "binary")(F.coalesce(F.col("_w0"), F.lit("")))})


def decode_media(media: Column) -> Column:
    """Struct (payload_bytes, payload_sha256, tail_crc32, feature) read from an Ogg column.

    A stream with a bad checksum, a lost page or an unfinished packet fails the job.
    """
    return F.arrow_udf(_read, "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")(media)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = encode_media(docs).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    read = stored.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), decode_media(F.col("media")).alias("r"))
    return read.select("doc_id", "n_bytes", "r.payload_bytes", "r.payload_sha256", "r.tail_crc32", "media_bytes", "media_sha256", "r.feature")
