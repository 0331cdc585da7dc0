"""LM scoring: masked pseudo-likelihood by a bidirectional window network in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinloom.llm.common import intake, outgo
from kinloom.llm.jaccard_join import _LOWER, _pieces, word_hashes
from kinloom.operators.recovery import checkpointed

#: Classes of tokens: the commonest words, hashed classes for all others, an edge.
COMMON, HASHED = 192, 64
EDGE = COMMON + HASHED
#: Neighbours that predict a token, by distance.
WINDOW = (-2, -1, 1, 2)
EMBED, HIDDEN = 16, 32
BATCH = 512
#: About so many of the commonest words are sent to tasks with their counts; those of all others are joined.
HEAD = 1 << 16
#: Logarithms of counts are summed as whole multiples of its inverse, so that sums do not hang on their order.
SCALE = 10**8
#: Networks averaged by one task.
FAN_IN = 32


@dataclass
class WindowNet:
    embed: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @staticmethod
    def fresh(seed: int) -> "WindowNet":
        rng = np.random.default_rng(seed)
        k = len(WINDOW) * EMBED
        parts = rng.normal(0, 0.3, (EDGE + 1, EMBED)), rng.normal(0, k**-0.5, (k, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, EDGE)), np.zeros(EDGE)
        return WindowNet(*(p.astype(np.float32) for p in parts))

    def pack(self) -> bytes:
        return b"".join(getattr(self, f.name).astype("<f4").tobytes() for f in fields(self))

    @staticmethod
    def unpack(raw: bytes) -> "WindowNet":
        out, at = WindowNet.fresh(0), 0
        for f in fields(out):
            shape = getattr(out, f.name).shape
            n = math.prod(shape)
            setattr(out, f.name, np.frombuffer(raw, "<f4", n, at).reshape(shape).astype(np.float32))
            at += 4 * n
        return out

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log p(target | its neighbours on both sides).

        The last product is in double precision, so that what a row gives does
        not hang on its place among others.
        """
        tables = [self.embed @ self.w1[k * EMBED : (k + 1) * EMBED] for k in range(len(WINDOW))]
        tables[0] = tables[0] + self.b1
        w2, b2, bounded = self.w2.astype(np.float64), self.b2.astype(np.float64), self.bounded()
        out = np.empty(len(target))
        for a in range(0, len(target), BATCH):
            c, t = context[a : a + BATCH], target[a : a + BATCH]
            hidden = tables[0][c[:, 0]]
            for k in range(1, len(WINDOW)):
                hidden += tables[k][c[:, k]]
            z = np.tanh(hidden, out=hidden).astype(np.float64) @ w2
            z = np.add(z, b2, out=np.empty(z.shape, np.float32), casting="unsafe")
            if not bounded:
                z -= z.max(1, keepdims=True)
            at = z[np.arange(len(t)), t].astype(np.float64)
            out[a : a + BATCH] = at - np.log(np.exp(z, out=z).sum(1).astype(np.float64))
        return out

    def bounded(self) -> bool:
        """Whether no input can make exp overflow, as hidden values are within -1 and 1."""
        return float((np.abs(self.w2).sum(0) + np.abs(self.b2)).max()) < 80


class Trainer:
    """Adam on batches of (context, target)."""

    def __init__(self, net: WindowNet, rate: float):
        self.net, self.rate, self.step = net, rate, 0
        self.moments = {f.name: [np.zeros_like(getattr(net, f.name)), np.zeros_like(getattr(net, f.name))] for f in fields(net)}

    def learn(self, context: np.ndarray, target: np.ndarray) -> None:
        net, n = self.net, len(target)
        x = net.embed[context].reshape(n, -1)
        hidden = x @ net.w1
        hidden += net.b1
        np.tanh(hidden, out=hidden)
        p = hidden @ net.w2
        p += net.b2
        if not net.bounded():
            p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p *= (1 / (n * (p @ np.ones(EDGE, np.float32))))[:, None]
        p[np.arange(n), target] -= np.float32(1 / n)
        dh = (p @ net.w2.T) * (1 - hidden**2)
        dx = (dh @ net.w1.T).reshape(n, len(WINDOW), EMBED)
        g = {"w2": (p.T @ hidden).T, "b2": p.sum(0), "w1": x.T @ dh, "b1": dh.sum(0)}
        flat = context.ravel().astype(np.int16)  # so narrow that the stable sort counts
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        g["embed"] = np.zeros_like(net.embed)
        g["embed"][flat[first]] = np.add.reduceat(dx.reshape(-1, EMBED)[order], first, axis=0)
        self.step += 1
        for k, (m, v) in self.moments.items():
            m += 0.1 * (g[k] - m)
            v += 0.01 * (g[k] ** 2 - v)
            w = getattr(net, k)
            w -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-6)


def _kinds(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    kind = COMMON + (hashes % np.uint64(HASHED)).astype(np.int64)
    at, known = _placed(hashes, common)
    return np.where(known, at, kind)


def _placed(hashes: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array of hashes, and which of them are there."""
    if not len(among):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.searchsorted(among, hashes)
    at[at == len(among)] = 0
    return at, among[at] == hashes


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after another, and the words of each text; short texts are hashed together."""
    if sum(map(len, texts)) > 8 << 20 or any(len(t) > 4 << 20 for t in texts):
        parts = [np.concatenate([word_hashes(p)[0] for p in _pieces(t.translate(_LOWER))]) for t in texts]
        return np.concatenate([np.zeros(0, np.uint64), *parts]), np.array([len(p) for p in parts], np.int64)
    hashes, starts = word_hashes(b"\n".join(texts).translate(_LOWER))
    return hashes, np.diff(np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)])))


def _joined(texts: list[bytes], common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token classes of all texts, two edges around each; the tokens of each text; all tokens' hashes."""
    hashes, counts = words_of(texts)
    out = np.full(len(hashes) + 2 * (len(texts) + 1), EDGE, np.int64)
    out[np.arange(len(hashes)) + 2 * np.repeat(np.arange(1, len(texts) + 1), counts)] = _kinds(hashes, common)
    return out, counts, hashes


def _grouped(column: pa.Array, size: int = 1 << 20) -> Iterator[list[bytes]]:
    group, total = [], 0
    for t in column.cast(pa.binary()):
        group.append(t.as_py() or b"")
        total += len(group[-1])
        if total > size:
            yield group
            group, total = [], 0
    if group:
        yield group


def _word_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in _grouped(batch.column(0), 8 << 20):
            hashes = [word_hashes(p)[0] for t in ([b"\n".join(texts)] if sum(map(len, texts)) < 32 << 20 else texts) for p in _pieces(t.translate(_LOWER))]
            words, counts = np.unique(np.concatenate(hashes), return_counts=True)
            yield pa.record_batch([pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64))], names=["word", "n"])


@dataclass
class Vocabulary:
    """Counts of every word of the corpus: a table (word, n), and what tasks hold of it."""

    counts: DataFrame
    common: np.ndarray
    head: np.ndarray
    #: ln of the head's counts and of the counts of all classes, in units of 1 / SCALE; 0 where the class is a word.
    head_logs: np.ndarray
    class_logs: np.ndarray


def _logs(n: np.ndarray) -> np.ndarray:
    return np.round(np.log(np.maximum(n, 1)) * SCALE).astype(np.int64)


def vocabulary(texts: DataFrame) -> Vocabulary:
    """Count all words; the COMMON commonest are classes of their own."""
    counts = checkpointed(texts.mapInArrow(_word_counter, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    top = counts.orderBy(F.desc("n"), "word").limit(COMMON).toPandas()
    common = np.sort(top.word.to_numpy(np.int64).view(np.uint64))
    step = F.floor(F.log2("n") * 8)
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("k")).orderBy(F.desc("step")).toPandas()
    fits = sizes.step[sizes.k.cumsum() <= HEAD]
    known = counts.where(step >= int(fits.min())).toPandas() if len(fits) else counts.limit(0).toPandas()
    known = known.assign(key=known.word.to_numpy(np.int64).view(np.uint64)).sort_values("key")
    head, n = known.key.to_numpy(np.uint64), known.n.to_numpy(np.int64)
    total = np.zeros(EDGE + 1, np.int64)
    for r in counts.groupBy(F.col("word").bitwiseAND(HASHED - 1).alias("kind")).agg(F.sum("n").alias("n")).collect():
        total[COMMON + r["kind"]] = r["n"]
    np.subtract.at(total, COMMON + (top.word.to_numpy(np.int64) & (HASHED - 1)), top.n.to_numpy(np.int64))
    logs = _logs(n)
    logs[_placed(head, common)[1]] = 0
    return Vocabulary(counts, common, head, logs, _logs(total))


def _tail_words(head: np.ndarray, common: np.ndarray):
    """Texts' keys to a row for each of their tokens that the head lacks; ``first`` is 1 once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, row = [batch.column(c).to_numpy() for c in ("k1", "k2")], 0
            for texts in _grouped(batch.column("text")):
                hashes, counts = words_of(texts)
                rare = ~_placed(hashes, head)[1] & ~_placed(hashes, common)[1]
                owner = row + np.repeat(np.arange(len(texts)), counts)[rare]
                row += len(texts)
                first = np.diff(owner, prepend=-1) != 0
                for a in range(0, len(owner), 1 << 17):
                    w = slice(a, a + (1 << 17))
                    yield pa.record_batch([pa.array(keys[0][owner[w]]), pa.array(keys[1][owner[w]]), pa.array(hashes[rare][w].view(np.int64)), pa.array(first[w].astype(np.int64))], names=["k1", "k2", "word", "first"])

    return run


def tail_logs(keyed: DataFrame, words: Vocabulary) -> DataFrame:
    """(k1, k2, tail): for every distinct text, the sum of ln count over its tokens outside the head.

    Equal texts share a key, so their sum is divided by how many they are.
    """
    rows = keyed.mapInArrow(_tail_words(words.head, words.common), "k1 long, k2 long, word long, first long")
    value = F.round(F.ln("n") * SCALE).cast("long")
    found = rows.join(words.counts.select("word", value.alias("v")), "word").groupBy("k1", "k2")
    return found.agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v"), F.sum("first").alias("copies")).select("k1", "k2", (F.col("v") / F.col("copies") / SCALE).cast("double").alias("tail"))


def _learner(start: bytes, common: np.ndarray, rounds: int, rate: float, turn: int):
    """A partition's texts to the network trained on this turn's share of their tokens, and how many taught it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, taught = Trainer(WindowNet.unpack(start), rate), 0
        rest = np.zeros((0, len(WINDOW)), np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for texts in _grouped(batch.column(0)):
                kinds, _, _ = _joined(texts, common)
                at = np.flatnonzero(kinds != EDGE)[turn::rounds]
                at = np.random.default_rng(len(at)).permutation(at)
                context = np.concatenate([rest[0], kinds[at[:, None] + np.array(WINDOW)]])
                target = np.concatenate([rest[1], kinds[at]])
                whole = len(target) // 1024 * 1024
                for a in range(0, whole, 1024):
                    trainer.learn(context[a : a + 1024], target[a : a + 1024])
                taught += whole
                rest = context[whole:], target[whole:]
        if len(rest[1]):
            trainer.learn(*rest)
            taught += len(rest[1])
        if taught:
            yield pa.record_batch([pa.array([trainer.net.pack()], pa.binary()), pa.array([taught], pa.int64())], names=["net", "n"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of the partition's networks, weighted by what taught them."""
    total, weight = 0.0, 0
    for batch in batches:
        for raw, n in zip(batch.column("net"), batch.column("n")):
            total = total + np.frombuffer(raw.as_py(), "<f4").astype(np.float64) * n.as_py()
            weight += n.as_py()
    if weight:
        yield pa.record_batch([pa.array([(total / weight).astype("<f4").tobytes()], pa.binary()), pa.array([weight], pa.int64())], names=["net", "n"])


def fit_window_net(texts: DataFrame, common: np.ndarray, rounds: int = 2, rate: float = 0.012, seed: int = 23) -> WindowNet:
    """Train on every token of every text: in each round all partitions train from
    the same network, and a tree of tasks averages the results.  Round r takes the
    tokens r, r + rounds, ..., so each token is a target once, whatever ``rounds``.

    Only one network (``FAN_IN`` at most) reaches the driver, whatever the input.
    """
    net = WindowNet.fresh(seed)
    for turn in range(rounds):
        nets = checkpointed(texts.mapInArrow(_learner(net.pack(), common, rounds, rate, turn), "net binary, n long"))
        many = nets.count()
        while many > 1:
            many = -(-many // FAN_IN)
            nets = checkpointed(nets.repartition(many, F.xxhash64("net")).mapInArrow(_average, "net binary, n long"))
        found = nets.collect()
        if not found:
            break
        net = WindowNet.unpack(bytes(found[0]["net"]))
    return net


def _scorer(net: bytes, common: np.ndarray, head: np.ndarray, head_logs: np.ndarray, class_logs: np.ndarray):
    def run(text: pa.Array) -> pa.Array:
        # Sums are rounded, so that a text's score does not hang on where it stands.
        model, sums, sizes = WindowNet.unpack(net), [], []
        for texts in _grouped(text):
            kinds, counts, hashes = _joined(texts, common)
            at = np.flatnonzero(kinds != EDGE)
            scores = np.empty(len(at))
            for a in range(0, len(at), 64 * BATCH):
                p = at[a : a + 64 * BATCH]
                scores[a : a + 64 * BATCH] = model.log_probabilities(kinds[p[:, None] + np.array(WINDOW)], kinds[p])
            place, known = _placed(hashes, head)
            inside = -class_logs[kinds[at]]
            inside[known] += head_logs[place[known]]
            total, some = np.zeros(len(counts)), counts > 0
            if some.any():
                firsts = (np.cumsum(counts) - counts)[some]
                total[some] = np.round(np.add.reduceat(scores, firsts), 6) + np.add.reduceat(inside, firsts) / SCALE
            sums.append(total)
            sizes.append(counts)
        empty = np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(np.concatenate([*sizes, empty.astype(np.int64)])), pa.array(np.concatenate([*sums, empty]))], ["n_tokens", "log_likelihood"])

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "n_tokens long, log_likelihood double")


def score_texts(docs: DataFrame, text_col: str = "text", **training) -> DataFrame:
    """Add ``n_tokens``, ``log_likelihood`` and ``perplexity`` to every document.

    Tokens are words in lower case.  p(token | two tokens on each side) is
    p(class | classes of these) by the network, times p(word | class), the
    word's share of its class in the whole corpus.  Classes are the COMMON
    commonest words and HASHED classes for the rest; the words are all those of
    the corpus, in a table that grows with it and is joined by word.
    ``log_likelihood`` sums log p over all tokens of the whole text;
    ``perplexity`` is exp(-mean).  Null, empty and blank texts have 0 tokens,
    likelihood 0 and no perplexity.  Equal texts score alike, to six decimals;
    other columns stay whatever their names and nulls; an empty table gives an
    empty one.
    """
    base, names = intake(docs, text_col)
    text = F.coalesce("_w0", F.lit(""))
    texts = base.select(text.alias("text"))
    words = vocabulary(texts)
    net = fit_window_net(texts, words.common, **training)
    keys = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    tail = tail_logs(base.select(keys[0].alias("k1"), keys[1].alias("k2"), text.alias("text")), words)
    scored = base.withColumn("_s", _scorer(net.pack(), words.common, words.head, words.head_logs, words.class_logs)(text)).withColumn("_k1", keys[0]).withColumn("_k2", keys[1])
    scored = scored.join(tail.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "tail"), ["_k1", "_k2"], "left")
    likelihood = F.round(F.col("_s.log_likelihood") + F.coalesce("tail", F.lit(0.0)), 6)
    mean = likelihood / F.nullif(F.col("_s.n_tokens"), F.lit(0))
    return outgo(scored, names, {text_col: F.col("_w0"), "n_tokens": F.col("_s.n_tokens"), "log_likelihood": likelihood, "perplexity": F.exp(-mean)})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs).select("doc_id", "n_tokens", "log_likelihood", "perplexity")
