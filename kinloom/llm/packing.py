"""Best-fit packing of documents into sequences, in bulk-synchronous steps."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from kinloom.llm.common import release_memory
from kinloom.operators.recovery import checkpointed

#: Words whose ids a worker keeps; beyond, it starts anew.
MAX_WORDS = 600_000

#: str.split() also cuts at these four, which are not white space to the tokenizer.
_ODD = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

_SIGNS = ".,;:!?%*#$&|()"

_tokenizers: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    """The library's tokenizer and the ids of the words it has met, as bytes."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path), {}
    return _tokenizers[path]


def _parts(word: str) -> tuple[str, str]:
    """Letters and the signs after them, which the tokenizer takes apart anyway.

    It does so after composing and lower-casing, so what is not all letters
    then is not parted here.
    """
    core = word.rstrip(_SIGNS)
    if core.isascii():
        return (core.lower(), word[len(core) :]) if core.isalpha() else (word, "")
    return (core, word[len(core) :]) if unicodedata.normalize("NFC", core).lower().isalpha() else (word, "")


def _encode_lines(tokenizer, cores: list[str]) -> dict[str, bytes]:
    """Ids of Latin words of letters only, from lines of them with full stops between, which costs half of a call for each word.

    The stop's id is no word's; a line that does not fall into as many parts as it has words gives nothing.
    """
    stop = tokenizer.encode(".", add_special_tokens=False).ids
    if len(stop) != 1:
        return {}
    out = {}
    lines = [cores[i : i + LINE_WORDS] for i in range(0, len(cores), LINE_WORDS)]
    for e, line in zip(tokenizer.encode_batch_fast([" . ".join(x) for x in lines], add_special_tokens=False), lines):
        ids = np.array(e.ids, "<u4")
        cuts = np.flatnonzero(ids == stop[0])
        if len(cuts) == len(line) - 1:
            raw, at = ids.tobytes(), 0
            for word, end in zip(line, (4 * np.append(cuts, len(ids))).tolist()):
                out[word] = raw[at:end]
                at = end + 4
    return out


def encode(texts: list[str], path: str) -> list[bytes]:
    """The library's ids (little-endian 32 bits) of each text.

    The tokenizer drops white space, lower-cases, parts letters from signs, and no
    rule of it looks further, so every such part is encoded once and kept.
    """
    tokenizer, known = _tokenizer(path)
    if len(known) > MAX_WORDS:
        known.clear()
    split = [[w for w in _WHITE.split(t) if w] if _ODD.search(t) else t.split() for t in texts]
    met = set(chain.from_iterable(split))
    new = {w: _parts(w) for w in met if w not in known}
    cores = list({c for pair in new.values() for c in pair if c and c not in known})
    plain = [c for c in cores if c.isalpha() and max(c) < "\u02b0"]
    known |= _encode_lines(tokenizer, plain)
    others = [c for c in cores if c not in known]
    for e, c in zip(tokenizer.encode_batch_fast(others, add_special_tokens=False), others):
        known[c] = np.array(e.ids, "<u4").tobytes()
    for w, (core, tail) in new.items():
        known[w] = known[core] + known[tail] if tail else known[core]
    here = {w: known[w] for w in met}  # small, so that looking up each occurrence stays in the CPU's caches
    return [b"".join(map(here.__getitem__, words)) for words in split]


def _cutter(path: str, capacity: int, schema: pa.Schema):
    """Batches of (id, text) to batches of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces(ids: list, texts: list[str]) -> pa.RecordBatch:
            out: list[tuple] = []
            for i, raw in zip(ids, encode(texts, path)):
                raw += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    out.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size > 1 << 20:
                    yield pieces(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield pieces(ids, texts)
        release_memory()

    return run


def cut_pieces(docs: DataFrame, path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as pieces of at most ``capacity`` tokens: (id, piece, start, length, ids_crc32)."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("piece", T.IntegerType())] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")])
    from pyspark.sql.pandas.types import to_arrow_schema

    return docs.select(id_col, text_col).mapInArrow(_cutter(path, capacity, to_arrow_schema(schema)), schema)


#: Words of one line that is encoded at once.
LINE_WORDS = 1000
#: Rows of one range of the sort, on average.
RANGE_ROWS = 100_000

_SWEPT = "side int, id long, size long, offset long, place long, mate long, at long"


def bracket(sides: np.ndarray) -> np.ndarray:
    """Pieces (0) and gaps (1) in order of size to each one's partner, or -1: a gap takes the nearest free piece before it.

    As brackets meet: between a piece and its gap all others have found each
    other.  Depth decides: the pieces and gaps of one depth take turns.
    """
    step = np.where(sides == 0, 1, -1)
    height = np.cumsum(step)
    # Depth over the lowest height so far, which gaps without a piece push down.
    floor = np.minimum.accumulate(np.minimum(height, 0))
    depth = height - floor + (sides == 1)
    fell = np.concatenate([[0], floor[:-1]]) != floor
    order = np.lexsort((np.arange(len(sides)), depth))
    order = order[~fell[order]]
    mates = np.full(len(sides), -1)
    left, right = order[:-1], order[1:]
    met = (depth[left] == depth[right]) & (sides[left] == 0) & (sides[right] == 1)
    mates[left[met]], mates[right[met]] = right[met], left[met]
    return mates


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range, sorted by size: what finds its partner here, and the place of the rest among those of its side."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    side, number, size, offset = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(4))
    mates = bracket(side)
    place = np.full(len(side), -1)
    for k in (0, 1):
        alone = np.flatnonzero((side == k) & (mates < 0))
        place[alone] = np.arange(len(alone))
    # A piece learns its gap and the offset there; the gap learns the piece's length.
    there = np.maximum(mates, 0)
    columns = [side.astype(np.int32), number, size, offset, place, np.where(mates < 0, -1, number[there]), np.where(mates < 0, -1, np.where(side == 0, offset[there], size[there]))]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in _SWEPT.split(", ")])


def carried(counts: dict[tuple[int, int], int], ranges: int) -> list[tuple[int, int, int, int, int, int]]:
    """How the free gaps of each range take the free pieces of the ranges before it, nearest first.

    ``counts`` gives those left by (range, side).  Rows (range of the pieces,
    first place, last + 1, range of the gaps, first place, number of the first
    pair): the last piece goes to the first gap, and so on.
    """
    out, stack, number = [], [], 0
    for r in range(ranges):
        taken, want = 0, counts.get((r, 1), 0)
        while taken < want and stack:
            from_, top = stack.pop()
            many = min(top, want - taken)
            out.append((from_, top - many, top, r, taken, number))
            taken, number = taken + many, number + many
            if top > many:
                stack.append((from_, top - many))
        if counts.get((r, 0)):
            stack.append((r, counts[r, 0]))
    return out


def _numbered(table: list[tuple]):
    """(range, side, place) to the number of the pair that it belongs to, or null."""
    sides = []
    for side in (0, 1):
        rows = [(t[0], t[1], t[2], t[5], -1) if side == 0 else (t[3], t[4], t[4] + t[2] - t[1], t[5], 1) for t in table]
        rows = np.array(sorted(rows), np.int64).reshape(-1, 5)
        sides.append((rows, rows[:, 0] * (1 << 40) + rows[:, 1]))

    def run(ranges: pa.Array, side: pa.Array, place: pa.Array) -> pa.Array:
        r, s, k = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (ranges, side, place))
        out = np.full(len(r), -1)
        for value, (rows, keys) in enumerate(sides):
            if not len(rows):
                continue
            at = np.maximum(np.searchsorted(keys, r * (1 << 40) + k, "right") - 1, 0)
            home, first, last, number, way = rows[at].T
            good = (s == value) & (home == r) & (k >= first) & (k < last)
            out = np.where(good, np.where(way < 0, number + last - 1 - k, number + k - first), out)
        return pa.array(out, mask=out < 0)

    run.__annotations__ = {"ranges": pa.Array, "side": pa.Array, "place": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "long")


def sweep(pieces: DataFrame, gaps: DataFrame, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One superstep: every gap takes the longest free piece that fits it.

    Pieces and gaps are sorted by size into ranges.  Within a range they meet
    like brackets; what is left of a range is counted, the counts, two for
    each range, say which ranges' rest meets which, and these meet by number.

    ``pieces(id, size)``, ``gaps(id, size, offset)``; gives placements (id,
    sequence_id, offset), the pieces left and the gaps as they are now.
    """
    spark = pieces.sparkSession
    n = max(1, -(-rows // RANGE_ROWS))
    order = ["size", "side", "tie"]
    both = pieces.select(F.lit(0).alias("side"), "id", "size", F.lit(0).cast("long").alias("offset")).unionByName(gaps.select(F.lit(1).alias("side"), "id", "size", "offset"))
    both = both.withColumn("tie", F.xxhash64("id"))
    dealt = (both.repartitionByRange(n, *order) if n > 1 else both.coalesce(1)).sortWithinPartitions(*order).drop("tie")
    swept = checkpointed(dealt.mapInArrow(_swept, _SWEPT).withColumn("range", F.spark_partition_id()))
    left = swept.where("place >= 0")
    table = []
    if n > 1:
        counts = {(r["range"], r["side"]): r["n"] for r in left.groupBy("range", "side").agg(F.count("*").alias("n")).collect()}
        table = carried(counts, n)
    met = swept.where("place < 0")
    placed = met.where("side = 0").select("id", F.col("mate").alias("sequence_id"), F.col("at").alias("offset"))
    filled = met.where("side = 1").select("id", (F.col("size") - F.col("at")).alias("size"), (F.col("offset") + F.col("at")).alias("offset"))
    if table:
        numbered = left.withColumn("pair", _numbered(table)(F.col("range"), F.col("side"), F.col("place")))
        far = numbered.where("pair is not null")
        joined = far.where("side = 0").select("pair", "id", F.col("size").alias("length")).join(far.where("side = 1").select("pair", F.col("id").alias("sequence_id"), "size", "offset"), "pair")
        joined = checkpointed(joined)
        placed = placed.unionByName(joined.select("id", "sequence_id", "offset"))
        filled = filled.unionByName(joined.select(F.col("sequence_id").alias("id"), (F.col("size") - F.col("length")).alias("size"), (F.col("offset") + F.col("length")).alias("offset")))
        left = numbered.where("pair is null")
    return placed, left.where("side = 0").select("id", "size"), filled.unionByName(left.where("side = 1").select("id", "size", "offset"))


def pack(pieces: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """Place pieces (with ``length`` from 1 to ``capacity``) in few sequences, by supersteps of best fit.

    Adds ``sequence_id`` and ``offset``; offsets in a sequence follow each other
    from 0 without gaps.  As many sequences are opened as the tokens need at
    least; each superstep (:func:`sweep`) gives every gap the longest free
    piece that fits, and goes on until nothing fits; then sequences are opened
    for what is left.  The driver sees counts and sums.  Sizes that a third of
    all pieces share are spread over ranges by a hash; null keys are keys like
    others; no pieces give no rows.
    """
    spark = pieces.sparkSession
    pieces = checkpointed(pieces).withColumn("_id", F.monotonically_increasing_id())
    free = pieces.select(F.col("_id").alias("id"), F.col("length").alias("size"))
    total = free.agg(F.count("*").alias("n"), F.sum("size").alias("tokens"), F.count(F.when(2 * F.col("size") > capacity, 1)).alias("large"), F.min("size").alias("least")).first()
    many, least = total["n"], total["least"]
    opened, placed = 0, []
    gaps = spark.range(0).select("id", F.col("id").alias("size"), F.col("id").alias("offset"))
    new = max(total["large"], -(-(total["tokens"] or 0) // capacity))
    held = 0
    while many:
        if new:
            fresh = spark.range(opened, opened + new).select("id", F.lit(capacity).cast("long").alias("size"), F.lit(0).cast("long").alias("offset"))
            gaps, opened, held = gaps.unionByName(fresh), opened + new, held + new
        done, free, gaps = sweep(free, gaps, many + held)
        placed.append(done)
        state = free.agg(F.count("*").alias("n"), F.sum("size").alias("tokens"), F.min("size").alias("least")).first()
        took, many, least = many - state["n"], state["n"], state["least"]
        if many:
            gaps = gaps.where(F.col("size") >= least)
            held = gaps.count()
            new = 0 if took and held else max(1, -(-state["tokens"] // capacity))
    if not placed:
        return pieces.select(*[c for c in pieces.columns if c[0] != "_"], F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).where("false")
    every = placed[0]
    for more in placed[1:]:
        every = every.unionByName(more)
    return pieces.join(every.withColumnRenamed("id", "_id"), "_id").select(*[c for c in pieces.columns if c[0] != "_"], "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, end each document with id 0, cut those above ``capacity`` and pack all pieces.

    Returns (id, piece, start, length, ids_crc32, sequence_id, offset).  ``path``
    names a tokenizer file that drops white space, seen by every executor.  Null
    and empty texts are one piece of one token.  Repeated rows and null ids are
    packed as rows of their own; other columns are not read.
    """
    return pack(cut_pieces(docs, path, capacity, id_col, text_col), capacity, id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
