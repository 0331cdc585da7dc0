"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kinloom.llm.common import intake, outgo

#: Chunks overlap by a filter's width at least, so no place of a text is missed.
CHUNK, STRIDE = 512, 448
WIDTH, EMBED, FILTERS, HIDDEN = 6, 8, 32, 16
#: Positions convolved at once.
ROWS = 64


@dataclass
class ByteNet:
    """Embedding, filters, a hidden layer on the chunk's maxima, and the weights
    that combine the chunks' logits (mean, largest, smallest) into the document's."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mix: np.ndarray

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        x = self.embed[chunks].reshape(len(chunks), -1)
        n, length = len(chunks), chunks.shape[1] - WIDTH + 1
        s0, s1 = x.strides
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(x, (n, length, WIDTH * EMBED), (s0, s1 * EMBED, s1)))

    def chunk_logits(self, chunks: np.ndarray) -> np.ndarray:
        """Each chunk is a product of its own and the small layers are in double
        precision, so that equal chunks give equal logits wherever they stand."""
        out = np.empty(len(chunks), np.float32)
        w1, w2 = self.w1.astype(np.float64), self.w2.astype(np.float64)
        for a in range(0, len(chunks), ROWS):
            z = np.matmul(self.windows(chunks[a : a + ROWS]), self.conv).max(1)
            hidden = np.maximum(np.maximum(z + self.bias, 0).astype(np.float64) @ w1 + self.b1, 0)
            out[a : a + ROWS] = (hidden @ w2)[:, 0] + self.b2
        return out

    def document_scores(self, texts: list[bytes]) -> np.ndarray:
        """One probability for each text; an empty one is a chunk of zero bytes."""
        logits = np.concatenate([self.chunk_logits(cut(t)) for t in _grouped(texts)])
        counts = np.array([n_chunks(len(t)) for t in texts])
        first = np.cumsum(counts) - counts
        mean = np.add.reduceat(logits.astype(np.float64), first) / counts
        feats = np.stack([mean, np.maximum.reduceat(logits, first), np.minimum.reduceat(logits, first), np.ones(len(texts))], 1)
        return np.round(1 / (1 + np.exp(-np.clip((feats * self.mix).sum(1), -40, 40))), 9)


def n_chunks(size: int) -> int:
    return 1 if size <= CHUNK else 1 + -(-(size - CHUNK) // STRIDE)


def cut(texts: list[bytes]) -> np.ndarray:
    """All overlapping chunks of the texts, the last of each padded with zero bytes."""
    rows = []
    for t in texts:
        n = n_chunks(len(t))
        flat = np.zeros((n - 1) * STRIDE + CHUNK, np.uint8)
        flat[: len(t)] = np.frombuffer(t, np.uint8)
        rows.append(np.lib.stride_tricks.as_strided(flat, (n, CHUNK), (STRIDE, 1)))
    return np.concatenate(rows)


def _grouped(texts: list[bytes]) -> list[list[bytes]]:
    groups, size = [[]], 0
    for t in texts:
        if size > 1 << 20:
            groups.append([])
            size = 0
        groups[-1].append(t)
        size += len(t)
    return groups


def train(chunks: np.ndarray, labels: np.ndarray, steps: int = 700, batch: int = 96, seed: int = 5) -> ByteNet:
    """Fit the chunk network by Adam on (chunk, label of its document), balanced by class."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    net = ByteNet(
        rng.normal(0, 0.5, (256, EMBED)).astype(f32), rng.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)).astype(f32), np.zeros(FILTERS, f32),
        rng.normal(0, (2 / FILTERS) ** 0.5, (FILTERS, HIDDEN)).astype(f32), np.zeros(HIDDEN, f32), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)).astype(f32), np.zeros(1, f32), np.array([1.0, 0, 0, 0]),
    )
    names = ("embed", "conv", "bias", "w1", "b1", "w2", "b2")
    moments = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in names}
    pools = [np.flatnonzero(labels == k) for k in (0, 1)]
    if not all(map(len, pools)):
        net.b2 += 4 if len(pools[1]) or not len(pools[0]) else -4
        net.w2 *= 0
        return net
    length = CHUNK - WIDTH + 1
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(p, batch // 2) for p in pools])
        x, y = chunks[pick], labels[pick].astype(f32)[:, None]
        # Some chunks are cut short, as those of short texts are, whatever their label.
        short = rng.integers(8, 384, batch)
        x = np.where((rng.random(batch) < 0.3)[:, None] & (np.arange(CHUNK) >= short[:, None]), 0, x).astype(np.uint8)
        win = net.windows(x)
        z = (win.reshape(len(x) * length, -1) @ net.conv).reshape(len(x), length, FILTERS)
        at = z.argmax(1)
        top = np.take_along_axis(z, at[:, None], 1)[:, 0] + net.bias
        pooled = np.maximum(top, 0)
        pre = pooled @ net.w1 + net.b1
        hidden = np.maximum(pre, 0)
        p = 1 / (1 + np.exp(-(hidden @ net.w2 + net.b2)))
        d = (p - y) / len(x)
        g = {"w2": hidden.T @ d, "b2": d.sum(0)}
        dh = (d @ net.w2.T) * (pre > 0)
        g["w1"], g["b1"] = pooled.T @ dh, dh.sum(0)
        dz = (dh @ net.w1.T) * (top > 0)
        g["bias"] = dz.sum(0)
        # Only the place of each maximum passes a gradient to its filter.
        places = win[np.arange(len(x))[:, None], at]
        g["conv"] = np.einsum("nfk,nf->kf", places, dz)
        back = (dz[:, :, None] * net.conv.T[None]).reshape(len(x), FILTERS, WIDTH, EMBED)
        bytes_at = x[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(WIDTH)]
        g["embed"] = np.zeros_like(net.embed)
        np.add.at(g["embed"], bytes_at, back)
        rate = 0.01 * min(1, 3 * (1 - step / (steps + 1)))
        for k in names:
            m, v = moments[k]
            m += 0.1 * (g[k] - m)
            v += 0.01 * (g[k] ** 2 - v)
            setattr(net, k, (getattr(net, k) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(f32))
    return net


def fit_mix(net: ByteNet, chunks: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> None:
    """Logistic regression, by Newton steps, of document labels on their chunks' logits."""
    logits = net.chunk_logits(chunks).astype(np.float64)
    n = owner.max() + 1
    count = np.bincount(owner, minlength=n)
    first = np.cumsum(count) - count
    x = np.stack([np.add.reduceat(logits, first) / count, np.maximum.reduceat(logits, first), np.minimum.reduceat(logits, first), np.ones(n)], 1)
    w = net.mix.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        # Half the weight goes to each label.
        c = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
        grad = x.T @ (c * (p - labels)) + 1e-3 * (w - [1, 0, 0, 0])
        hess = (x * (c * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(4)
        w = w - np.linalg.solve(hess, grad)
    net.mix = w


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = 1500, label_chunks: int = 20_000, steps: int = 700) -> ByteNet:
    """Train on a bounded sample of labelled rows: ``per_label`` documents of each
    label, in the order of a hash of the id, as far as their chunks number at most
    ``label_chunks`` (so at most 2 x 20,000 x 512 bytes reach the driver, 20 MB).
    A row taken teaches with all its chunks; one that alone has over a twentieth
    of ``label_chunks`` is not taken.

    Labels that are null, other than 0 and 1, or that contradict each other for
    one id are left out; without both labels the scores are constant.
    """
    known = (
        labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)")
        .groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2")
    )
    keys = known.select("i", "y", F.xxhash64(F.lit(3), "i").alias("h"))
    chosen = keys.where("y = 0").orderBy("h", "i").limit(per_label).unionByName(keys.where("y = 1").orderBy("h", "i").limit(per_label))
    texts = docs.select(F.col(id_col).alias("i"), F.encode(F.coalesce(text_col, F.lit("")), "utf-8").alias("t"))
    size = F.octet_length("t")
    n = F.when(size <= CHUNK, 1).otherwise(1 + F.ceil((size - CHUNK) / STRIDE))
    found = texts.join(F.broadcast(chosen), "i").groupBy("i", "y", "h").agg(F.max("t").alias("t")).withColumn("n", n).where(F.col("n") <= label_chunks // 20)
    # The window sees per_label rows of a label at most.
    taken = found.withColumn("upto", F.sum("n").over(Window.partitionBy("y").orderBy("h", "i"))).where(F.col("upto") <= label_chunks)
    parts = taken.select("h", "y", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"), "t").select("h", "y", "i", "k", F.substring("t", F.col("k").cast("int") * STRIDE + 1, F.lit(CHUNK)).alias("c"))
    rows = parts.toPandas().sort_values(["h", "i", "k"])
    if not len(rows):
        return train(np.zeros((0, CHUNK), np.uint8), np.zeros(0, int))
    chunks = np.zeros((len(rows), CHUNK), np.uint8)
    for at, c in enumerate(rows.c):
        chunks[at, : len(c)] = np.frombuffer(bytes(c), np.uint8)
    y = rows.y.to_numpy()
    net = train(chunks, y, steps)
    owner = (rows.i.to_numpy()[1:] != rows.i.to_numpy()[:-1]).cumsum()
    owner = np.concatenate([[0], owner])
    fit_mix(net, chunks, owner, y[np.flatnonzero(np.diff(owner, prepend=-1))])
    return net


def _scorer(net: ByteNet):
    def run(text: pa.Array) -> pa.Array:
        out, group, size = [], [], 0
        for one in text.cast(pa.binary()):
            group.append(one.as_py() or b"")
            size += len(group[-1])
            if size > 4 << 20:
                out.append(net.document_scores(group))
                group, size = [], 0
        if group:
            out.append(net.document_scores(group))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")


def score_quality(docs: DataFrame, net: ByteNet, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    The whole text is read in overlapping chunks; rows are independent, nothing
    is shuffled, and only the text is an input.  Null text scores as empty text;
    equal texts score alike; other columns stay whatever their names and nulls;
    an empty table gives an empty one.
    """
    base, names = intake(docs, text_col)
    scored = base.withColumn("_s", _scorer(net)(F.coalesce(F.col("_w0"), F.lit(""))))
    return outgo(scored, names, {text_col: F.col("_w0"), "score": F.col("_s"), "predicted": (F.col("_s") >= threshold).cast("int")})


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fitted(spark: SparkSession, sf_dir: str) -> ByteNet:
    """The network trained on the labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return fit_quality(docs, labels)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_quality(docs, fitted(spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
