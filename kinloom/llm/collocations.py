"""Phrase collocations by vertical positional inverted lists."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kinloom.llm.common import GROUP_BYTES, LOWER, UPPER, intake, release_memory
from kinloom.llm.jaccard_join import _BYTE, _mix, _powers
from kinloom.operators.recovery import checkpointed, fresh_folder

#: Bytes of text whose inverted lists are built together.
BLOCK_BYTES = 6 << 20

#: What ends a piece, and what parts words within it.
BREAKS = ".,;:!?\n\x0b\x0c\r"
BLANKS = " \t"

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS.encode())] = True
_APART = _BREAK.copy()
_APART[list(BLANKS.encode())] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)

BLOCKS = "lang string, size long, text binary"
PARTIALS = "part int, block long, n long, keys binary, counts binary"
MARKS = "block long, part int, often binary, own binary, sums binary"
LISTS = "kind int, lang string, key long, k1 long, k2 long, n long, w1 string, w2 string"


def _zip(raw: bytes) -> bytes:
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unzip(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int(np.frombuffer(raw, np.int64, 1)[0]), codec="zstd", asbytes=True)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as distances, byte by byte, so that their zero bytes shrink."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return _zip(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(_unzip(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def _cuts(text: bytes) -> Iterator[tuple[int, int]]:
    """Stretches of about GROUP_BYTES that end where a word ends."""
    data, at = np.frombuffer(text, np.uint8), 0
    while len(text) - at > 2 * GROUP_BYTES:
        end = at + GROUP_BYTES
        while end < len(text):
            gap = np.flatnonzero(_APART[data[end : end + 4096]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + 4096, len(text))
        yield at, end
        at = end
    yield at, len(text)


class Postings:
    """The words of one block of text: key, place in the text, and position.

    Positions count words and skip one where a piece ends, so two words are
    adjacent in one piece exactly when their positions differ by one.
    """

    def __init__(self, text: bytes, lang: str):
        data = np.frombuffer(text, np.uint8)
        keys, starts, ends, ended = [], [], [], [np.zeros(0, np.int64)]
        for a, b in _cuts(text):
            part = data[a:b]
            inside = np.concatenate([[False], ~_APART[part], [False]])
            turns = np.flatnonzero(inside[1:] != inside[:-1])
            s, e = turns[::2], turns[1::2]
            _powers.to(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * _powers.up[: len(part)], out=sums[1:])
            keys.append(_mix((sums[e] - sums[s]) * _powers.down[s] + (e - s).astype(np.uint64)))
            starts.append(s + a)
            ends.append(e + a)
            ended.append(np.flatnonzero(_BREAK[part]) + a)
        seed = np.uint64(int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "little"))
        self.text, self.starts, self.ends = text, np.concatenate(starts), np.concatenate(ends)
        self.words = _mix(np.concatenate(keys) ^ seed)
        pieces = np.searchsorted(np.concatenate(ended), self.starts)
        self.positions = np.arange(len(self.words)) + np.cumsum(np.diff(pieces, prepend=0) > 0)
        if len(text) < 1 << 30:  # places and positions stay below the bytes of the block
            self.starts, self.ends, self.positions = (x.astype(np.int32) for x in (self.starts, self.ends, self.positions))

    def extended(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of occurrences that end at word ``at``, those followed by a word of their piece, and that word.

        A merge join of the occurrences' next positions with the postings' positions.
        """
        wanted = self.positions[at] + 1
        found = np.searchsorted(self.positions, wanted).astype(self.positions.dtype)
        hit = found < len(self.positions)
        hit[hit] = self.positions[found[hit]] == wanted[hit]
        return np.flatnonzero(hit).astype(found.dtype), found[hit]

    def word(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]].decode()


def _pairs(p: Postings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all phrases of two words, and the places of both words."""
    first, second = p.extended(np.arange(len(p.words)))
    return _mix(p.words[first] * _STEP + _mix(p.words[second])), first, second


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys and how often each occurs."""
    held = np.concatenate(keys)
    held.sort()
    heads = np.flatnonzero(np.concatenate([np.ones(min(len(held), 1), bool), held[1:] != held[:-1]]))
    return held[heads], np.diff(heads, append=len(held))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of one language joined to blocks of about BLOCK_BYTES, in lower case."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def flush(lang: str) -> pa.RecordBatch:
        text = b"\n".join(held.pop(lang)).translate(_LOWER)
        sizes.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([len(text)]), pa.array([_zip(text)], pa.binary())], ["lang", "size", "text"])

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
            lang, raw = lang.as_py(), text.as_py()
            held.setdefault(lang, []).append(raw)
            sizes[lang] = sizes.get(lang, 0) + len(raw) + 1
            if sizes[lang] >= BLOCK_BYTES:
                yield flush(lang)
            elif sum(sizes.values()) >= 2 * BLOCK_BYTES:
                yield flush(max(sizes, key=sizes.get))
    for lang in list(held):
        yield flush(lang)
    release_memory()


def _count(parts: int):
    """Lengths of a block's lists, by ranges of the keys."""
    bounds = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lang, text in zip(*(batch.column(i) for i in range(3))):
                with np.errstate(over="ignore"):
                    p = Postings(_unzip(text.as_py()), lang.as_py())
                    keys, counts = _distinct(p.words, _pairs(p)[0])
                cuts = [0, *np.searchsorted(keys, bounds), len(keys)]
                rows = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k for k, _, _ in rows], pa.int32()),
                            pa.array([block.as_py()] * len(rows), pa.int64()),
                            pa.array([b - a for _, a, b in rows], pa.int64()),
                            pa.array([_pack(keys[a:b]) for _, a, b in rows], pa.binary()),
                            pa.array([_zip(counts[a:b].astype("<u4").tobytes()) for _, a, b in rows], pa.binary()),
                        ],
                        ["part", "block", "n", "keys", "counts"],
                    )
                del p, keys, counts, rows
                release_memory()

    return run


def _decide(least: int):
    """Sums of the lists' lengths over all blocks; each block learns which of its phrases are frequent.

    Of the blocks that hold a frequent phrase, the first one is told its length.
    """

    def run(group: pa.Table) -> pa.Table:
        sizes = group["n"].to_numpy()
        keys = np.concatenate([_unpack(x.as_py()) for x in group["keys"]])
        counts = np.concatenate([np.frombuffer(_unzip(x.as_py()), "<u4") for x in group["counts"]]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        heads = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]) != 0)
        sums = np.add.reduceat(counts[order], heads)
        spread = np.repeat(sums >= least, np.diff([*heads, len(order)]))
        often, total = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        often[order] = spread
        total[order[heads]] = np.where(sums >= least, sums, 0)
        cuts = np.cumsum([0, *sizes])
        out = {"often": [], "own": [], "sums": []}
        for a, b in zip(cuts, cuts[1:]):
            mine = total[a:b]
            out["often"].append(_zip(np.packbits(often[a:b]).tobytes()))
            out["own"].append(_zip(np.packbits(mine > 0).tobytes()))
            out["sums"].append(_zip(mine[mine > 0].astype("<i8").tobytes()))
        release_memory()
        return pa.table({"block": group["block"], "part": group["part"], **{k: pa.array(v, pa.binary()) for k, v in out.items()}})

    return run


def _bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(_unzip(raw), np.uint8), count=n).astype(bool)


def _lists(parts: int):
    """Frequent words and pairs a block was told to report, and its lists of three words."""
    bounds = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text, marks in zip(*(batch.column(i) for i in range(3))):
                lang = lang.as_py()
                with np.errstate(over="ignore"):
                    p = Postings(_unzip(text.as_py()), lang)
                    pairs, first, second = _pairs(p)
                    keys = _distinct(p.words, pairs)[0]
                cuts = [0, *np.searchsorted(keys, bounds), len(keys)]
                often, own = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
                sums = np.zeros(len(keys), np.int64)
                for mark in marks.as_py() or ():
                    a, b = cuts[mark["part"]], cuts[mark["part"] + 1]
                    often[a:b] = _bits(mark["often"], b - a)
                    own[a:b] = _bits(mark["own"], b - a)
                    sums[a:b][own[a:b]] = np.frombuffer(_unzip(mark["sums"]), "<i8")
                yield _rows(0, lang, [0], [0], [0], [len(p.words)])
                mine, lengths = keys[own], sums[own]
                for kind, held in ((1, p.words), (2, pairs)):
                    if not len(mine) or not len(held):
                        continue
                    at = np.minimum(np.searchsorted(mine, held), len(mine) - 1)
                    hit = np.flatnonzero(mine[at] == held)
                    which, place = np.unique(at[hit], return_index=True)
                    if not len(which):
                        continue
                    i = hit[place]
                    if kind == 1:
                        yield _rows(1, lang, mine[which], mine[which] * 0, mine[which] * 0, lengths[which])
                    else:
                        texts = [[p.word(x) for x in side[i]] for side in (first, second)]
                        yield _rows(2, lang, mine[which], p.words[first[i]], p.words[second[i]], lengths[which], *texts)
                frequent = keys[often]
                if len(frequent) and len(pairs):
                    at = np.minimum(np.searchsorted(frequent, pairs), len(frequent) - 1)
                    kept = np.flatnonzero(frequent[at] == pairs)  # the lists of frequent pairs, by occurrence
                    begun, last = p.extended(second[kept])  # merge-joined with the postings of the adjacent words
                    # The words before ``last`` begin pairs of their own; the longer phrase needs that pair to be frequent too.
                    after = np.searchsorted(first, last - 1)
                    good = np.isin(after, kept, assume_unique=False)
                    left, right = pairs[kept[begun[good]]], pairs[after[good]]
                    with np.errstate(over="ignore"):
                        both = _mix(left * _STEP + _mix(right))
                    _, place, counts = np.unique(both, return_index=True, return_counts=True)
                    if len(place):
                        yield _rows(3, lang, left[place] * 0, left[place], right[place], counts)
                    del at, kept, begun, last, after, good, left, right, both, place
                del p, pairs, first, second, keys, often, own, sums, mine, frequent
                release_memory()

    return run


def _rows(kind: int, lang: str, key, k1, k2, n, w1=None, w2=None) -> pa.RecordBatch:
    size = len(n)
    signed = [pa.array(np.asarray(x, np.uint64).view(np.int64)) for x in (key, k1, k2)]
    words = [pa.array(w, pa.string()) if w is not None else pa.nulls(size, pa.string()) for w in (w1, w2)]
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * size, pa.int32()), pa.array([lang] * size), *signed, pa.array(np.asarray(n, np.int64)), *words],
        ["kind", "lang", "key", "k1", "k2", "n", "w1", "w2"],
    )


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)) in decimals of 38 digits: exact up to 10^16 occurrences."""
    a, left, right = (F.col(c).cast("decimal(19,0)") for c in (a, left, right))
    over, under = (a * a).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), left * right
    rest = over % under  # taken away first, so that the division leaves nothing to round
    return ((over - rest) / under).cast("decimal(38,0)").cast("long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """The best phrases of two and three words of each language.

    Text in lower case (A-Z) is cut into pieces at ``BREAKS`` and these into
    words at ``BLANKS``.  A phrase's ``a`` counts all its occurrences within
    pieces; it is a candidate from ``min_count``.  Its score is the least of
    floor(1000000 a a / (l r)) over its cuts in two, l and r being the counts
    of the parts, ties to the first cut.  A candidate goes when a longer one
    that holds it occurs at least ``inside`` per cent as often.

    Texts of a language are joined to blocks.  A block's inverted lists are its
    words' and pairs' sorted positions; it sends their lengths, by ranges of
    the keys, to be summed, which gives exact frequencies, and gets back one
    bit for each of its phrases.  Lists of frequent pairs are then extended by
    a merge join of their positions with the adjacent words' postings.  No
    table of phrases goes to every task, and a block is bounded in bytes, so a
    language or phrase that holds most of the text is spread over tasks.
    Words and phrases are told apart by 64-bit keys.

    Null language: ``und``; null and empty texts hold no words; a language
    without candidates gives no row.  Very long texts are read whole, repeated
    rows count each time, ties go by phrase in byte order, other columns are
    not read, and an empty table gives an empty one.

    Columns: lang, rank, phrase, a, l, r, n (words of the language), score.
    """
    spark = docs.sparkSession
    base, _ = intake(docs, lang_col, text_col)
    base = base.where("_w1 is not null and _w1 <> ''").select(F.coalesce("_w0", F.lit("und")).alias("lang"), F.col("_w1").alias("text"))
    path = fresh_folder(spark)
    base.mapInArrow(_gather, BLOCKS).withColumn("block", F.monotonically_increasing_id()).write.parquet(path)
    blocks = spark.read.schema("lang string, size long, text binary, block long").parquet(path)
    total = blocks.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-total // BLOCK_BYTES))

    partial = blocks.select("block", "lang", "text").mapInArrow(_count(parts), PARTIALS)
    marks = partial.groupBy("part").applyInArrow(_decide(min_count), MARKS)
    marks = checkpointed(marks).groupBy("block").agg(F.collect_list(F.struct("part", "often", "own", "sums")).alias("marks"))
    rows = checkpointed(blocks.join(marks, "block", "left").select("lang", "text", "marks").mapInArrow(_lists(parts), LISTS))

    words = rows.where("kind = 1").select("key", F.col("n").alias("f"))
    pairs = rows.where("kind = 2").select("lang", "key", "k1", "k2", F.col("n").alias("a"), "w1", "w2")
    pairs = pairs.join(words.toDF("k1", "l"), "k1").join(words.toDF("k2", "r"), "k2").select("lang", "key", "w1", "w2", "a", "l", "r")
    pairs = checkpointed(pairs)
    triples = rows.where("kind = 3").groupBy("k1", "k2").agg(F.sum("n").alias("a")).where(F.col("a") >= min_count)
    head = pairs.select(F.col("key").alias("k1"), "lang", "w1", "w2", F.col("a").alias("f12"), F.col("l").alias("f1"))
    tail = pairs.select(F.col("key").alias("k2"), F.col("w2").alias("w3"), F.col("a").alias("f23"), F.col("r").alias("f3"))
    triples = checkpointed(triples.join(head, "k1").join(tail, "k2"))

    near = triples.select(F.explode(F.array("k1", "k2")).alias("key"), F.col("a").alias("longer")).groupBy("key").agg(F.max("longer").alias("longer"))
    short = pairs.join(near, "key", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    short = short.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score("a", "l", "r").alias("score"))
    long = triples.withColumn("s1", _score("a", "f1", "f23")).withColumn("s2", _score("a", "f12", "f3"))
    early = F.col("s1") <= F.col("s2")
    long = long.select(
        "lang",
        F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"),
        "a",
        F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = short.unionByName(long).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    sizes = rows.where("kind = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
f1 AS MATERIALIZED (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(ws) AS p FROM w) GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, u, v, count(*) AS f FROM (SELECT lang, unnest(ws[:-2]) AS u, unnest(ws[2:]) AS v FROM w WHERE len(ws) > 1) GROUP BY ALL),
f3 AS MATERIALIZED (SELECT lang, u, v, x, count(*) AS f FROM (SELECT lang, unnest(ws[:-3]) AS u, unnest(ws[2:-2]) AS v, unnest(ws[3:]) AS x FROM w WHERE len(ws) > 2) GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
c2 AS (
  SELECT f2.lang, u || ' ' || v AS phrase, f2.f AS a, x.f AS l, y.f AS r, (1000000::HUGEINT * f2.f * f2.f) // (x.f::HUGEINT * y.f) AS score
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.p = u JOIN f1 y ON y.lang = f2.lang AND y.p = v
  WHERE f2.f >= 10 AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.u = f2.u AND f3.v = f2.v AND 100 * f3.f >= 50 * f2.f)
    AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.v = f2.u AND f3.x = f2.v AND 100 * f3.f >= 50 * f2.f)),
c3 AS (
  SELECT f3.lang, f3.u || ' ' || f3.v || ' ' || f3.x AS phrase, f3.f AS a, s.f AS s, vx.f AS vx, uv.f AS uv, e.f AS e,
    (1000000::HUGEINT * f3.f * f3.f) // (s.f::HUGEINT * vx.f) AS s1, (1000000::HUGEINT * f3.f * f3.f) // (uv.f::HUGEINT * e.f) AS s2
  FROM f3 JOIN f1 s ON s.lang = f3.lang AND s.p = f3.u JOIN f1 e ON e.lang = f3.lang AND e.p = f3.x
  JOIN f2 uv ON uv.lang = f3.lang AND uv.u = f3.u AND uv.v = f3.v JOIN f2 vx ON vx.lang = f3.lang AND vx.u = f3.v AND vx.v = f3.x),
cand AS (
  SELECT lang, phrase, a, l, r, score FROM c2 UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN s ELSE uv END, CASE WHEN s1 <= s2 THEN vx ELSE e END, least(s1, s2) FROM c3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM cand)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
