"""Collocations against a plain count, and their edge cases."""

import random
import re
from collections import Counter

import pytest

from kinloom.llm import collocations as co

COLUMNS = "lang rank phrase a l r n score".split()


def plain(table, least=10, inside=50, top=2000):
    counts, sizes = {}, Counter()
    for lang, text in table:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in (1, 2, 3):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        good = {p for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p in good:
            if any(p in (q[:2], q[1:]) and 100 * f[q] >= inside * f[p] for q in good if len(q) > len(p)):
                continue
            score, k = min((1000000 * f[p] ** 2 // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -f[p], " ".join(p).encode(), f[p], f[p[:k]], f[p[k:]], score))
        for rank, (_, _, phrase, a, left, right, score) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, sizes[lang], score))
    return sorted(out)


def run(spark, table, **kw):
    rows = co.collocations(spark.createDataFrame(table, "lang string, text string"), **kw)
    return sorted(tuple(r[c] for c in COLUMNS) for r in rows.collect())


def table(seed=1, docs=120):
    rng = random.Random(seed)
    words = ["a", "b", "É", "é", "New", "york", "cd", "x y", "to", "be"]
    out = []
    for _ in range(docs):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randrange(60)))
        out.append((rng.choice(["en", "en", "de", None]), rng.choice([text, text + " New York City", ""])))
    return out + [("en", None), ("fr", "one two"), ("x", "")]


def test_plain(spark):
    assert run(spark, table()) == plain(table())


@pytest.mark.parametrize("kw", [{"min_count": 2}, {"min_count": 3, "inside": 90}, {"top": 7}, {"inside": 10}])
def test_parameters(spark, kw):
    names = {"min_count": "least", "inside": "inside", "top": "top"}
    assert run(spark, table(2), **kw) == plain(table(2), **{names[k]: v for k, v in kw.items()})


def test_blocks_of_any_size(spark, monkeypatch):
    """Many small blocks, cut texts and many ranges of keys give the same; so does one language that holds all."""
    rows = [("en", t) for _, t in table(3, 60)] + [("en", "long words here " * 3000)]
    want = run(spark, rows)
    assert want == plain(rows)
    small = co.BLOCK_BYTES, co.GROUP_BYTES
    try:
        co.BLOCK_BYTES, co.GROUP_BYTES = 3000, 1000  # the ranges follow the blocks; workers keep the module's own
        assert run(spark, rows) == want
        text = ("word. " * 700 + "é" * 5000 + " a b a b,") * 2
        p = co.Postings(text.encode(), "en")
    finally:
        co.BLOCK_BYTES, co.GROUP_BYTES = small
    q = co.Postings(text.encode(), "en")
    assert (p.words == q.words).all() and (p.positions == q.positions).all() and (p.starts == q.starts).all()


def test_repeated_word_overlaps(spark):
    rows = [("en", "go go go go go go go go go go go go go")]
    assert run(spark, rows) == plain(rows)


def test_empty_and_clashing(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([("en", "a b " * 20, 1, 2)], "lang string, text string, block int, LANG_ int").withColumnRenamed("LANG_", "key")
    assert co.collocations(df).count() == len(plain([("en", "a b " * 20)]))


def test_keys_round_trip():
    import numpy as np

    keys = np.unique(np.random.default_rng(0).integers(0, 2**64, 999, np.uint64))
    assert (co._unpack(co._pack(keys)) == keys).all()
