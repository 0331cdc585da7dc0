"""N-gram Jaccard join by vertical partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinloom.llm.common import GROUP_BYTES, LOWER, SPACE, UPPER, intake, outgo, release_memory
from kinloom.operators.components import connected_components
from kinloom.operators.recovery import checkpointed

#: Members of a shared n-gram that meet in one task; larger groups meet by blocks.
BLOCK = 2048
#: Ranges of the global order (runs of fragments) whose partial overlaps are counted apart.
SLICES = 4
#: Bytes of text that one fragment's n-grams come from, on average.
FRAGMENT_BYTES = 64 << 20
#: Bits of a document's bitmap, which bounds overlaps from above.
BITS = 2048

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_WHITE = np.zeros(256, bool)
_WHITE[list(SPACE.encode())] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, np.uint64) * 2 + 1
_ROOT = 0x9E3779B97F4A7C15 | 1
_ROOT_INVERSE = pow(_ROOT, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of a root modulo 2^64, and their inverses, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) <= n:
            for name, root in (("up", _ROOT), ("down", _ROOT_INVERSE)):
                line = np.full(n + 1, root, np.uint64)
                line[0] = 1
                setattr(self, name, np.multiply.accumulate(line))


_powers = _Powers()


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of lower-cased bytes, and where each begins."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], ~_WHITE[data], [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    _powers.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers.up[: len(data)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * _powers.down[starts] + (ends - starts).astype(np.uint64)), starts


def _pieces(raw: bytes) -> Iterator[bytes]:
    """Long bytes in pieces of about GROUP_BYTES, cut at white space."""
    at = 0
    while len(raw) - at > 2 * GROUP_BYTES:
        end = next((i for i in range(at + GROUP_BYTES, len(raw)) if _WHITE[raw[i]]), len(raw))
        yield raw[at:end]
        at = end
    yield raw[at:]


def _shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of one text; of all its words if they are fewer."""
    k = min(n, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            total = _mix(total * np.uint64(_ROOT) + words[i : len(words) - k + 1 + i])
    return np.unique(total)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if group:
            hashes, starts = word_hashes(b"\n".join(group))
            bounds = np.cumsum([0, *(len(t) + 1 for t in group)])
            cuts = np.searchsorted(starts, bounds)
            out.extend(_shingles(hashes[a:b], n) for a, b in zip(cuts, cuts[1:]))
        group, size = [], 0

    for text in texts:
        text = text.translate(_LOWER)
        if len(text) > 2 * GROUP_BYTES:
            flush()
            out.append(_shingles(np.concatenate([word_hashes(p)[0] for p in _pieces(text)]), n))
            continue
        group.append(text)
        size += len(text)
        if size > GROUP_BYTES:
            flush()
    flush()
    return out


# ------------------------------------------------- fragments of the order
# A blob holds, for one fragment: how many documents, their ids as distances from
# the least one, the digests and sizes of their whole sets, how many of their
# n-grams fall into the fragment, and these, 40 bits each.  Ids and counts take
# the narrow type where all of the blob's fit it.
_HEAD = (("id", "<u4", "<i8"), ("s", "<u8", "<u8"), ("n", "<u4", "<u4"), ("k", "<u2", "<u4"))


def _blob(head: dict, grams: np.ndarray) -> bytes:
    least = int(head["id"].min())
    head = head | {"id": head["id"] - least}
    kinds = [narrow if int(head[c].max()) <= np.iinfo(narrow).max else wide for c, narrow, wide in _HEAD]
    first = np.array([len(head["id"]), least, *(k == wide for k, (_, _, wide) in zip(kinds, _HEAD))], "<i8")
    parts = [first.tobytes(), *(head[c].astype(k).tobytes() for k, (c, _, _) in zip(kinds, _HEAD))]
    return b"".join([*parts, grams.astype("<u4").tobytes(), (grams >> np.uint64(32)).astype("u1").tobytes()])


def _unblob(raw: bytes) -> tuple[dict, np.ndarray]:
    many, least, *wide = np.frombuffer(raw, "<i8", 2 + len(_HEAD)).tolist()
    at, head = 8 * (2 + len(_HEAD)), {}
    for use, (c, narrow, broad) in zip(wide, _HEAD):
        head[c] = np.frombuffer(raw, broad if use else narrow, many, at)
        at += head[c].nbytes
        head[c] = head[c] if c == "s" else head[c].astype(np.int64)
    head["id"] = head["id"] + least
    total = int(head["k"].sum())
    low = np.frombuffer(raw, "<u4", total, at).astype(np.uint64)
    return head, low | np.frombuffer(raw, "u1", total, at + 4 * total).astype(np.uint64) << np.uint64(32)


def _splitter(fragments: int, n: int):
    """Batches of (id, text) to (fragment, blob)."""

    def emit(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(sets)), sizes)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(flat + np.uint64(3)))])
            edge = np.concatenate([[0], np.cumsum(sizes)])
            digest = _mix(sums[edge[1:]] - sums[edge[:-1]])
        home = (digest % np.uint64(fragments)).astype(np.int64)
        ids = np.array(ids, np.int64)
        part = (((flat >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, owner, grams = part[order], owner[order], flat[order] & np.uint64((1 << 40) - 1)
        cuts = np.searchsorted(part, np.arange(fragments + 1))
        blobs = []
        for f in range(fragments):
            a, b = cuts[f], cuts[f + 1]
            count = np.bincount(owner[a:b], minlength=len(sets))
            here = np.flatnonzero((count > 0) | (home == f))
            if len(here):
                blobs.append((f, _blob({"id": ids[here], "s": digest[here], "n": sizes[here], "k": count[here]}, grams[a:b])))
        return pa.record_batch([pa.array([f for f, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary())], names=["fragment", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                ids.append(i)
                texts.append(t.as_py() or b"")
                size += len(texts[-1])
                if size > 8 * GROUP_BYTES:
                    yield emit(ids, shingle_sets(texts, n))
                    ids, texts, size = [], [], 0
        if ids:
            yield emit(ids, shingle_sets(texts, n))
        release_memory()

    return run


FRAGMENT = "head boolean, f int, id long, rep long, n int, m int, grams binary"


def _packed(grams: np.ndarray, sixth: np.ndarray) -> bytes:
    """Six bytes for each n-gram: its 40 bits and one more byte."""
    out = np.empty((len(grams), 6), np.uint8)
    out[:, :5] = grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    out[:, 5] = sixth
    return out.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    """What :func:`_packed` made, as 48-bit numbers."""
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _steps(counts: np.ndarray) -> np.ndarray:
    """Counts as steps of one byte, eight for each doubling; what is more frequent is never lower."""
    return np.minimum(255, np.floor(8 * np.log2(counts))).astype(np.uint8)


def _fragment(fragments: int):
    """One fragment: who has which set, and the n-grams that several sets hold."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        f = key[0].as_py()
        read = [_unblob(x.as_py()) for x in table.column("blob")]
        head = {c: np.concatenate([h[c] for h, _ in read]) for c, _, _ in _HEAD}
        grams = np.concatenate([g for _, g in read])
        # Equal sets have one representative, the smallest id; empty sets each their own.
        order = np.lexsort((head["id"], head["n"], head["s"]))
        new = np.ones(len(order), bool)
        for c in ("s", "n"):
            new[1:] &= head[c][order][1:] == head[c][order][:-1]
        new[1:] = ~new[1:]
        new[:1] = True
        new |= head["n"][order] == 0
        rep = np.empty(len(order), np.int64)
        rep[order] = head["id"][order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        leads = np.zeros(len(order), bool)
        leads[order[new]] = True
        owner = np.repeat(np.arange(len(order)), head["k"])
        keep = leads[owner]
        owner, grams = owner[keep], grams[keep]
        by = np.argsort(grams, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], np.diff(grams[by]) != 0])) if len(by) else np.zeros(0, np.int64)
        counts = np.empty(len(by), np.int64)
        counts[by] = np.repeat(np.diff(np.append(edge, len(by))), np.diff(np.append(edge, len(by))))
        shared = counts > 1
        owner, packed = owner[shared], _packed(grams[shared], _steps(counts[shared]))
        sizes = np.bincount(owner, minlength=len(order))
        docs = np.flatnonzero(sizes)
        ends = 6 * np.cumsum(sizes[docs])
        offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64).tobytes())
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(docs), [None, offsets, pa.py_buffer(packed)]).cast(pa.binary())
        mine = np.flatnonzero((head["s"] % np.uint64(fragments)).astype(np.int64) == f)
        both = np.concatenate([mine, docs])
        columns = [
            pa.array(np.repeat([True, False], [len(mine), len(docs)])),
            pa.array(np.full(len(both), f, np.int32)),
            pa.array(head["id"][both]),
            pa.array(rep[both]),
            pa.array(head["n"][both].astype(np.int32)),
            pa.array(np.concatenate([np.zeros(len(mine)), sizes[docs]]).astype(np.int32)),
            pa.chunked_array([pa.nulls(len(mine), pa.binary()), parts]),
        ]
        release_memory()
        return pa.table(columns, names=["head", "f", "id", "rep", "n", "m", "grams"])

    return run


SETS = "id long, n int, m long, keys array<long>, bits binary, parts array<binary>"


def _prefixer(percent: int, fragments: int):
    """(id, n, fragments' shared n-grams) to the rare n-grams of which any partner must
    share one, a bitmap, and the n-grams by slice of the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, maps, parts, sizes = [], [], [], []
            for n, found in zip(batch.column("n").to_pylist(), batch.column("found")):
                f = found.values.field("f").to_numpy()
                read = [_unpacked(x.as_py()) for x in found.values.field("grams")]
                low = np.concatenate(read)
                of = np.repeat(f, [len(x) for x in read]).astype(np.uint64)
                step, low = low >> np.uint64(40), low & np.uint64((1 << 40) - 1)
                grams = of << np.uint64(40) | low
                least = -(-percent * n // 100)
                # n-grams of no other set stand first in the order and need no lookup.
                many = n - least + 1 - (n - len(grams))
                keys.append(grams[np.lexsort((grams, step))[:many]].view(np.int64))
                bits = np.zeros(BITS, bool)
                bits[_mix(grams) % np.uint64(BITS)] = True
                maps.append(np.packbits(bits).tobytes())
                order = np.sort(grams)
                cuts = np.searchsorted((order >> np.uint64(40)) * np.uint64(SLICES) // np.uint64(fragments), np.arange(SLICES + 1))
                parts.append([_packed(g, (g >> np.uint64(40)).astype(np.uint8)) for g in (order[a:b] for a, b in zip(cuts, cuts[1:]))])
                sizes.append(len(grams))
            yield pa.record_batch(
                [batch.column("id"), batch.column("n"), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(maps, pa.binary()), pa.array(parts, pa.list_(pa.binary()))],
                names=["id", "n", "m", "keys", "bits", "parts"],
            )

    return run


PAIRS = pa.schema([("x", pa.int64()), ("y", pa.int64())])


def _bound(a: dict, i, b: dict, percent: int) -> np.ndarray:
    """Upper bound of the Jaccard of row i of a with every row of b, in hundredths, -1 if below the threshold."""
    lost_a = np.bitwise_count(a["bits"][i][None, :] & ~b["bits"]).sum(1, dtype=np.int64)
    lost_b = np.bitwise_count(b["bits"] & ~a["bits"][i][None, :]).sum(1, dtype=np.int64)
    common = np.minimum(a["m"][i] - lost_a, b["m"] - lost_b)
    union = a["n"][i] + b["n"] - common
    return np.where(100 * common >= percent * union, 100 * common / np.maximum(union, 1), -1.0)


def _streamed(solve, keys: tuple[str, ...]):
    """Batches sorted by the keys, solved group by group."""

    def columns(t: pa.Table) -> dict:
        t = t.combine_chunks()
        raw = b"".join(x.as_py() for x in t.column("bits"))
        out = {c: t.column(c).to_numpy() for c in t.column_names if c not in ("bits", *keys)}
        return out | {"bits": np.frombuffer(raw, np.uint64).reshape(t.num_rows, -1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _ended(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                table = pa.Table.from_batches([batch])
                table = pa.concat_tables([rest, table]) if rest is not None else table
            elif rest is None:
                return
            else:
                table = rest
            marks = np.stack([table.column(k).to_numpy() for k in keys])
            edges = np.concatenate([[0], np.flatnonzero((np.diff(marks, axis=1) != 0).any(0)) + 1, [table.num_rows]])
            done = len(edges) - 1 if batch is None else len(edges) - 2
            if done:
                t = columns(table.slice(0, edges[done]))
                found = [solve({c: v[a:b] for c, v in t.items()}) for a, b in zip(edges[:done], edges[1 : done + 1])]
                pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
                yield pa.record_batch([pairs.min(1, initial=2**62), pairs.max(1, initial=-(2**62))], schema=PAIRS)
            rest = table.slice(edges[done])

    return run


def _ended(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _forest(percent: int):
    """Likely links that span a group: a breadth-first forest over bounds, and best partners."""

    def solve(t: dict) -> np.ndarray:
        n, out, todo = len(t["id"]), [], np.ones(len(t["id"]), bool)
        queue: list[int] = []
        while todo.any():
            if not queue:
                queue.append(int(np.argmax(todo)))
                todo[queue[0]] = False
            i = queue.pop()
            near = _bound(t, i, t, percent)
            near[i] = -1
            fresh = np.flatnonzero(todo & (near >= 0))
            out.append(np.stack([np.full(len(fresh), i), fresh], 1))
            if near.max(initial=-1) >= 0:
                out.append(np.array([[i, int(near.argmax())]]))
            todo[fresh] = False
            queue += fresh.tolist()
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *out]).astype(np.int64)
        return t["id"][pairs].reshape(-1, 2) if n > 1 else np.zeros((0, 2), np.int64)

    return solve


def _crossing(percent: int):
    """All pairs of different components that the bounds leave possible, between a left and a right block."""

    def solve(t: dict) -> np.ndarray:
        left, right = np.flatnonzero(t["left"]), np.flatnonzero(t["right"])
        b, out = {k: v[right] for k, v in t.items()}, []
        for i in left:
            same = (b["component"] == t["component"][i]) | (b["left"] & (b["id"] <= t["id"][i]))
            hit = right[(_bound(t, i, b, percent) >= 0) & ~same]
            out.append(np.stack([np.full(len(hit), t["id"][i]), t["id"][hit]], 1))
        return np.concatenate([np.zeros((0, 2), np.int64), *out]).astype(np.int64)

    return solve


def _partial_overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, y, nx, ny, px, py) of one slice each to the n-grams that px and py share."""
    for whole in batches:
        for a in range(0, whole.num_rows, 4096):
            batch = whole.slice(a, 4096)
            marked = []
            for c in ("px", "py"):
                raw = [x.as_py() for x in batch.column(c)]
                row = np.repeat(np.arange(len(raw), dtype=np.uint64), [len(r) // 6 for r in raw])
                marked.append(row << np.uint64(48) | _unpacked(b"".join(raw)))
            both = np.sort(np.concatenate(marked), kind="stable")
            shared = (both[:-1][both[1:] == both[:-1]] >> np.uint64(48)).astype(np.int64)
            o = np.bincount(shared, minlength=batch.num_rows)
            yield pa.record_batch([*(batch.column(c) for c in ("x", "y", "nx", "ny")), pa.array(o.astype(np.int64))], names=["x", "y", "nx", "ny", "o"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link: partial overlaps are counted in every slice of the order and summed per pair."""
    parts = sets.select("id", "n", F.posexplode("parts").alias("slice", "part"))
    each = pairs.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    x, y = (parts.select(F.col("id").alias(c), "slice", F.col("n").alias(f"n{c}"), F.col("part").alias(f"p{c}")) for c in "xy")
    # Sets grow with the input, so neither side is ever a broadcast.
    met = each.join(y.hint("merge"), ["y", "slice"]).join(x.hint("merge"), ["x", "slice"]).select("x", "y", "nx", "ny", "px", "py")
    total = met.mapInArrow(_partial_overlaps, "x long, y long, nx int, ny int, o long").groupBy("x", "y").agg(F.sum("o").alias("o"), F.max("nx").alias("nx"), F.max("ny").alias("ny"))
    return total.where(100 * F.col("o") >= percent * (F.col("nx") + F.col("ny") - F.col("o"))).select("x", "y")


def _groups(postings: DataFrame) -> DataFrame:
    """(gram, size) of the n-grams with several members, one for each set of members."""
    sized = postings.groupBy("gram").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("a"), F.bit_xor(F.xxhash64(F.lit(5), "id")).alias("b")).where("size > 1")
    return sized.groupBy("size", "a", "b").agg(F.min("gram").alias("gram")).select("gram", "size")


def _class_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (x, y) between representatives that connect all that the exact join would."""
    postings = sets.select("id", F.explode("keys").alias("gram"))
    # Written apart from the join, so that a frequent n-gram's postings can be split over tasks.
    groups = checkpointed(_groups(postings))
    facts = sets.select("id", "n", "m", "bits").hint("merge")
    members = checkpointed(postings.join(groups.hint("merge"), "gram"))
    rich = members.join(facts, "id").withColumn("blocks", F.expr(f"(size + {BLOCK - 1}) div {BLOCK}"))
    own = rich.withColumn("own", F.expr("pmod(xxhash64(id), blocks)"))
    # Every block meets itself and the first block, which ties the blocks together.
    met = own.withColumn("block", F.explode(F.when(F.col("own") == 0, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("own"))))
    met = met.select("gram", "block", "id", "n", "m", "bits").repartition("gram", "block").sortWithinPartitions("gram", "block")
    likely = met.mapInArrow(_streamed(_forest(percent), ("gram", "block")), "x long, y long").distinct()
    first = checkpointed(_verified(likely, sets, percent))
    parts = connected_components(first, "x", "y")

    # Groups that are still in several components: the largest one, and the rest against all.
    marked = checkpointed(members.join(parts, "id", "left").select("gram", "id", F.coalesce("component", "id").alias("component")))
    counts = marked.groupBy("gram", "component").agg(F.count("*").alias("k"))
    split = counts.groupBy("gram").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("size"), F.max("k").alias("most"), F.count("*").alias("parts")).where("parts > 1")
    split = split.withColumn("rest_blocks", F.expr(f"(size - most + {BLOCK - 1}) div {BLOCK}")).withColumn("main_blocks", F.expr(f"(most + {BLOCK - 1}) div {BLOCK}"))
    split = checkpointed(split.select("gram", "main", "rest_blocks", "main_blocks"))
    open_ = marked.join(split.hint("merge"), "gram").join(facts, "id")
    is_main = F.col("component") == F.col("main")
    zero = F.lit(0).cast("long")
    block = F.when(is_main, F.col("rest_blocks") + F.expr("pmod(xxhash64(id), main_blocks)")).otherwise(F.expr("pmod(xxhash64(id), rest_blocks)"))
    every = F.sequence(zero, F.col("rest_blocks") - 1)
    as_right = F.transform(F.filter(every, lambda i: is_main | (i <= F.col("own"))), lambda i: F.struct(i.alias("i"), F.col("own").alias("o"), (i == F.col("own")).alias("left"), F.lit(True).alias("right")))
    as_left = F.when(is_main, F.array().cast("array<struct<i:bigint,o:bigint,left:boolean,right:boolean>>")).otherwise(
        F.transform(F.filter(F.sequence(zero, F.col("rest_blocks") + F.col("main_blocks") - 1), lambda o: o > F.col("own")), lambda o: F.struct(F.col("own").alias("i"), o.alias("o"), F.lit(True).alias("left"), F.lit(False).alias("right"))))
    dealt = open_.withColumn("own", block).withColumn("to", F.explode(F.concat(as_right, as_left))).select("gram", F.col("to.i").alias("i"), F.col("to.o").alias("o"), F.col("to.left").alias("left"), F.col("to.right").alias("right"), "id", "n", "m", "bits", "component")
    dealt = dealt.repartition("gram", "i", "o").sortWithinPartitions("gram", "i", "o")
    crossing = dealt.mapInArrow(_streamed(_crossing(percent), ("gram", "i", "o")), "x long, y long").distinct()
    return checkpointed(first.unionByName(_verified(crossing, sets, percent)))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, fragments: int | None = None) -> DataFrame:
    """Connect documents whose sets of ``words``-word shingles have a Jaccard of ``percent`` % or more.

    Adds ``n_shingles`` (the set's size) and ``component_id`` (smallest id
    reachable by links, itself included).

    The global order of n-grams, by hash, is cut into ``fragments`` (default:
    one for each FRAGMENT_BYTES of text, and no fewer than the session's shuffle
    partitions, so that a fragment fits its task at any size).  In a fragment,
    equal sets are folded to their smallest id and the n-grams of several sets
    are counted.  What a set
    shares with nobody stands first in its order by count, so a set without
    enough shared n-grams leaves here; the others are looked up by the rarest
    n-grams of their prefix.  A group around an n-gram first tries links that
    would span it; only members of different components are compared further,
    by bitmaps that bound the overlap from above.  What decides a candidate is
    its overlap: the fragments' n-grams, in SLICES runs of fragments, are
    intersected apart, and the partial overlaps are summed per pair.  No link
    between components is lost, and a group of near copies costs about as many
    pairs as it has members.

    A-Z are lower-cased; words are runs without ``[\\x20\\x09-\\x0D]``; a text with
    fewer words is one shingle.  Null, empty and blank texts have no shingles
    and stand alone.  A null id is never linked (component null).  Rows that
    repeat an id are one document, of which the greatest text counts.  Shingles
    are compared by 64-bit hashes (40 bits and the fragment
    once split, and 64 bits and the size for whole sets).  An
    empty table gives an empty one.  Texts of any length are read whole; n-grams
    of one frequency are in the order of their hashes; columns named like the
    operator's own do no harm.
    """
    spark = docs.sparkSession
    base, names = intake(docs, id_col, text_col)
    texts = base.where("_w0 is not null").select(F.col("_w0").cast("long").alias("id"), F.coalesce("_w1", F.lit("")).alias("text"))
    if texts.select("id").groupBy("id").count().where("count > 1").limit(1).count():
        texts = texts.groupBy("id").agg(F.max("text").alias("text"))
    if fragments is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        fragments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FRAGMENT_BYTES))
    fragments = min(fragments, 1 << 22)
    blobs = texts.mapInArrow(_splitter(fragments, words), "fragment int, blob binary")
    read = checkpointed(blobs.groupBy("fragment").applyInArrow(_fragment(fragments), FRAGMENT))
    heads = read.where("head").select("id", "rep", "n")
    shared = read.where("not head").groupBy("id").agg(F.max("n").alias("n"), F.sum("m").alias("m"), F.collect_list(F.struct("f", "grams")).alias("found"))
    able = shared.where(100 * F.col("m") >= percent * F.col("n")).select("id", "n", "found")
    sets = checkpointed(able.mapInArrow(_prefixer(percent, fragments), SETS))
    parts = connected_components(_class_links(sets, percent), "x", "y")
    found = heads.join(parts.select(F.col("id").alias("rep"), "component"), "rep", "left").select(F.col("id").alias("_id"), F.col("n").cast("long").alias("_n"), F.coalesce("component", "rep").alias("_component"))
    rows = base.join(found, base["_w0"].cast("long") == F.col("_id"), "left")
    return outgo(rows, names, {id_col: F.col("_w0"), text_col: F.col("_w1"), "n_shingles": F.coalesce("_n", F.lit(0)).cast("long"), "component_id": F.col("_component")})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")
