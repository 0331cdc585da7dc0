"""Embedding near-dedup: hyperplane signs, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinloom.llm.common import intake, outgo
from kinloom.operators.components import connected_components
from kinloom.operators.recovery import checkpointed

#: Rows of one side of a bucket that meet in a task; larger buckets meet block by block.
BLOCK = 2048
#: Buckets up to this size are compared by shifts of the whole batch.
SMALL = 24
#: Rows of an average bucket of the largest label, and how likely a pair at the threshold is to be found.
BUCKET_ROWS, RECALL = 512, 0.9992
#: The list of buckets above BLOCK is broadcast up to this many rows.
BROADCAST_BUCKETS = 50_000
#: Bucket, id, copies, keys of all tables, vector.
LINKS = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])


def _signer(tables: int, bits: int, seed: int):
    """Vectors to their sign keys, one for each table."""

    def run(vectors: pa.Array) -> pa.Array:
        sizes = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        first = np.cumsum(sizes) - sizes
        keys = np.zeros((len(sizes), tables), np.int32)
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            x = flat[first[rows][:, None] + np.arange(dim)]
            planes = np.random.default_rng([seed, int(dim)]).standard_normal((dim, tables * bits))
            signs = (x @ planes > 0).reshape(len(rows), tables, bits)
            keys[rows] = signs @ (1 << np.arange(bits))
        offsets = pa.array(np.arange(0, keys.size + 1, tables), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(keys.ravel(), pa.int32()))

    run.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<int>")


class _Union:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, a: int) -> int:
        while self.up.setdefault(a, a) != a:
            self.up[a] = a = self.up[self.up[a]]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def _stars(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The smallest id that each row of a square link matrix reaches."""
    label = ids.copy()
    while True:
        low = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
        new = np.minimum(label, low)
        if (new == label).all():
            return label
        label = new


def _fresh(keys_a: np.ndarray, keys_b: np.ndarray, table: int) -> np.ndarray:
    """Pairs that share no bucket in an earlier table, so that each counts once."""
    seen = np.zeros((len(keys_a), len(keys_b)), bool)
    for t in range(table):
        seen |= keys_a[:, t][:, None] == keys_b[:, t][None, :]
    return ~seen


def _large(ids, copies, keys, unit, table, half, threshold):
    """Links of one bucket or one pair of its blocks; ``half`` tells the first block's rows.

    With two blocks only pairs between them count here.
    """
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    if half is not None:
        near &= half[:, None] != half[None, :]
    links = ((near & _fresh(keys, keys, table)) * copies[None, :]).sum(1)
    return links, _stars(ids, near)


def _linker(threshold: float):
    """Batches sorted by bucket to (id, links, an id that all rows linked in the bucket share)."""

    def solve(t: dict) -> pa.RecordBatch:
        ids, copies, keys, group, table = t["id"], t["n"], t["keys"], t["group"], t["table"]
        n = len(ids)
        links, low = np.zeros(n, np.int64), ids.copy()
        edges = np.flatnonzero(np.diff(group)) + 1
        starts, stops = np.concatenate([[0], edges]), np.concatenate([edges, [n]])
        sizes = stops - starts
        size_of = np.repeat(sizes, sizes)
        unit = t["unit"]
        union = _Union()
        plain = (size_of <= SMALL) & (t["two"] == 0)
        for shift in range(1, int(size_of[plain].max(initial=1))):
            a = np.flatnonzero(plain[:-shift] & (group[:-shift] == group[shift:]))
            b = a + shift
            near = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
            a, b = a[near], b[near]
            earlier = np.arange(keys.shape[1])[None, :] < table[a][:, None]
            fresh = ~((keys[a] == keys[b]) & earlier).any(1)
            np.add.at(links, a[fresh], copies[b[fresh]])
            np.add.at(links, b[fresh], copies[a[fresh]])
            for i, j in zip(a.tolist(), b.tolist()):
                union.join(i, j)
        for i in list(union.up):
            low[i] = ids[union.root(i)]
        for k in np.flatnonzero((sizes > SMALL) | ((t["two"][starts] == 1) & (sizes > 1))):
            s = slice(starts[k], stops[k])
            half = t["half"][s] if t["two"][starts[k]] else None
            links[s], low[s] = _large(ids[s], copies[s], keys[s], unit[s], table[starts[k]], half, threshold)
        found = (links > 0) | (low != ids)
        return pa.record_batch([ids[found], links[found], low[found]], schema=LINKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            marks = np.stack([table.column(k).to_numpy() for k in ("label", "dim", "table", "key", "i", "j")])
            group = np.concatenate([[0], np.cumsum((np.diff(marks, axis=1) != 0).any(0))])
            last = int(np.searchsorted(group, group[-1]))
            if last:
                yield solve(_arrays(table.slice(0, last), group[:last]))
            rest = table.slice(last)
        if rest is not None:
            yield solve(_arrays(rest, np.zeros(rest.num_rows, np.int64)))

    return run


def _arrays(table: pa.Table, group: np.ndarray) -> dict:
    """Numpy columns; the unit vectors are padded with zeros to one width."""
    table = table.combine_chunks()
    lists = table.column("vector").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    dims = table.column("dim").to_numpy()
    unit = np.zeros((len(dims), int(dims.max())))
    unit[np.arange(unit.shape[1])[None, :] < dims[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    unit /= np.abs(unit).max(1, keepdims=True)
    unit /= np.sqrt((unit**2).sum(1, keepdims=True))
    keys = table.column("keys").combine_chunks()
    keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
    own, i, j = (table.column(k).to_numpy() for k in ("own", "i", "j"))
    return {
        "id": table.column("id").to_numpy().copy(), "n": table.column("n").to_numpy(), "table": table.column("table").to_numpy(), "unit": unit, "group": group,
        "keys": keys.flatten().to_numpy().reshape(len(dims), -1), "two": (i != j).astype(int), "half": own == i,
    }


def tables_for(bits: int, threshold: float) -> int:
    """How many tables of ``bits`` signs find a pair at the threshold with probability RECALL."""
    one = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return 1 if one == 1 else math.ceil(math.log(1 - RECALL) / math.log(1 - one))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, bits: int | None = None, tables: int | None = None, seed: int = 17) -> DataFrame:
    """Link vectors of one label with a cosine of ``threshold`` or more.

    Adds ``n_links`` (other vectors linked directly), ``component_id`` (smallest
    id reachable) and ``kept`` (id = component_id).  Equal vectors are first
    folded into one row with a count.  Each fold goes to one bucket in each of
    ``tables`` tables, by the signs at ``bits`` random hyperplanes; all pairs of
    a bucket are verified in double precision, a pair in the first table that
    holds it.  By default ``bits`` follow the largest label (12, and one more for
    each doubling beyond BUCKET_ROWS rows in an average bucket), and ``tables``
    follow ``bits``, so that a pair at the threshold shares a bucket with
    probability RECALL at any size.  A bucket above BLOCK rows is compared block by block, so no
    task holds it whole; counts and stars come out, never pairs.

    Null vectors, zero vectors, vectors with null or non-finite components and
    rows with null label or id have no links and stand alone (component = own
    id).  Only vectors of one length are compared.  Rows that repeat an id and
    vector are one vector; an id with several vectors has the links of each row's
    own vector and one component.  An empty table gives an empty one.  Ids are
    long integers, or text that reads as such.  Other columns are
    kept or left by position, so clashing names do no harm.
    """
    base, names = intake(vectors, id_col, vector_col, label_col)
    good = F.col("_w0").isNotNull() & F.col("_w2").isNotNull() & F.forall("_w1", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("_w1", lambda x: x != 0)
    marks = {"h1": F.xxhash64("_w2", "_w1"), "h2": F.xxhash64(F.lit(9), "_w2", "_w1")}
    valid = base.where(F.coalesce(good, F.lit(False))).select(F.col("_w0").cast("long").alias("id"), F.xxhash64("_w2").alias("label"), F.col("_w1").alias("vector"), *[c.alias(n) for n, c in marks.items()])
    folds = valid.select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    folds = checkpointed(folds)
    heads = valid.dropDuplicates(["h1", "h2", "id"]).join(folds, ["h1", "h2", "id"])
    heads = heads.select("id", "n", "label", "vector", F.size("vector").cast("long").alias("dim"))
    if bits is None:
        most = heads.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 1
        bits = max(12, math.ceil(math.log2(most / BUCKET_ROWS)))
    tables = tables or tables_for(bits, threshold)
    signed = checkpointed(heads.withColumn("keys", _signer(tables, bits, seed)(F.col("vector"))))

    bucket = ["label", "dim", "table", "key"]
    slim = signed.select("label", "dim", F.posexplode("keys").alias("table", "key"))
    crowded = checkpointed(slim.groupBy(*bucket).agg(F.count("*").alias("size")).where(F.col("size") > BLOCK))
    many = crowded.count()
    spread = signed.select("id", "n", "label", "dim", "vector", "keys", F.posexplode("keys").alias("table", "key"))
    if many:
        side = F.broadcast(crowded) if many <= BROADCAST_BUCKETS else crowded
        spread = spread.join(side, bucket, "left")
    else:
        spread = spread.withColumn("size", F.lit(None).cast("long"))
    blocks = F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("long")
    spread = spread.withColumn("blocks", blocks).withColumn("own", F.expr("pmod(xxhash64(id), blocks)")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.select("label", "dim", F.col("table").cast("long").alias("table"), F.col("key").cast("long").alias("key"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "keys", "vector")
    order = ["label", "dim", "table", "key", "i", "j"]
    links = spread.repartition(*order).sortWithinPartitions(*order).mapInArrow(_linker(threshold), "id long, links long, to long")
    links = checkpointed(links)
    counted = links.groupBy("id").agg(F.sum("links").alias("linked"))
    parts = connected_components(links.where("id <> to"), "id", "to")
    per_fold = (
        folds.join(counted, "id", "left").join(parts, "id", "left")
        .select("h1", "h2", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    # Rows that link with nothing take no part in the join, and a vector that very many rows hold can be split there.
    per_fold, is_good = checkpointed(per_fold), F.coalesce(good, F.lit(False))
    linked = base.where(is_good).select("*", *[c.alias(n) for n, c in marks.items()]).join(per_fold, ["h1", "h2"], "left").drop("h1", "h2")
    rows = linked.unionByName(base.where(~is_good), allowMissingColumns=True)
    whole = F.coalesce("component_id", F.col("_w0").cast("long"))
    return outgo(
        rows,
        names,
        {id_col: F.col("_w0"), vector_col: F.col("_w1"), label_col: F.col("_w2"), "n_links": F.coalesce("n_links", F.lit(0)).cast("long"), "component_id": whole, "kept": F.col("_w0").eqNullSafe(whole)},
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return near_duplicates(vectors).select("vec_id", "n_links", "component_id", "kept")
