"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names; and brute force."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from kinloom.llm import embedding_dedup, html_text, jaccard_join, line_dedup, lm_scoring, mixing, ogg_media, packing, quality, token_counts
from kinloom.operators.recovery import checkpointed

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, TEXT_ string, _rest int, n_tokens string, component_id string, size string, score string, h long, n_lines int"


def corpus():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(40)]
    texts = base + base[:5] + [" ".join(w for w in t.split() if rng.random() > 0.02) for t in base[:25]]
    texts += [None, "", "   \n\t ", "one", "ONE", "a b c d", "x" * 5000, "y " * 30000, "shared line that repeats\nown 1 here it is", "Shared line that REPEATS \nown 2 here it is", "l\n\nl", "<|endoftext|> don't 'tis  　é日本 ½"]
    rows = [(i, t, None if i % 7 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id at all in this one", "s1"), (None, None, None)]
    return [(*r, "c", 1, "c", "c", "c", "c", 5, 6) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def test_line_dedup(docs, empty):
    assert line_dedup.dedup_lines(empty).count() == 0
    got = sorted((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs).where("doc_id is not null").collect())
    first, count = {}, {}
    rows = [(r[0], r[1] or "") for r in corpus()]
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for line in t.split("\n"):
            if i is not None and len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), i), i)
                count.setdefault(key(line), set()).add(i)
    want = []
    for i, t in rows:
        if i is not None:
            kept = [x for x in t.split("\n") if not (len(key(x)) >= 10 and len(count[key(x)]) > 1 and first[key(x)] < i)]
            want.append((i, "\n".join(kept), len(t.split("\n")), len(t.split("\n")) - len(kept)))
    assert got == sorted(want)
    three = line_dedup.dedup_lines(docs, min_docs=3)
    assert three.count() == len(rows)


def test_html():
    page = """<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a href=x>Home</a></nav><div class="ad">Buy the best of it now and here.</div>
    <article><h1>Head &amp; line</h1><p>First <b>part</b> &nbsp; of the <br>text.</p><p>Yes.</p><div id="comments"><p>Nice one, said the reader of it.</p></div></article><footer>&copy; us</footer></body></html>"""
    assert html_text.main_text(page) == "Head & line\n\nFirst part of the text.\n\nYes."
    for broken in ("", "<", "<p", "<div", "<!--", "<script>", "a < b", "<p a='", "</div></p>", "<a>" * 500):
        html_text.main_text(broken)


@pytest.mark.parametrize("value", ["A" * 12_000, "{'html': '<b>it</b>'} " * 800, "data:,>" * 3000])
def test_html_long_attributes(value):
    rest = '<p>Second paragraph, it is here.</p><p>Third with a "quote" in it.</p></article>'
    for q in "\"'":
        v = value.replace("'", "") if q == "'" else value
        assert html_text.main_text(f'<article><p>First of them.</p><img src={q}{v}{q} alt="x">{rest}') == 'First of them.\n\nSecond paragraph, it is here.\n\nThird with a "quote" in it.'
    open_ = f'<article><p>First of <a href="it>them</a>.</p><p>{"So it was. " * 1000}</p><p><a href="x">Last</a> of the text.</p></article>'
    assert html_text.main_text(open_) == f"First of them.\n\n{('So it was. ' * 1000).strip()}\n\nLast of the text."


def test_html_time_is_linear():
    """Sixteen times the tags take nowhere near 256 times the time."""
    pages = [lambda n: "<p>" + "<b>x</b> " * n + "</p>", lambda n: "<div>" * n + "text of it" + "</div>" * n, lambda n: "<div>" * n + "</span></td>" * n, lambda n: "<aside>" + "<main>" * n + "it</main>"]
    for page in pages:
        took = []
        for n in (1000, 16_000):
            start = time.process_time()
            html_text.main_text(page(n))
            took.append(time.process_time() - start)
        assert took[1] < 60 * max(took[0], 0.004)


def test_ids_of_every_letter_before_a_sign():
    """Letters and signs are parted only where the library parts them."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, letters = Tokenizer.from_file(path), [chr(c) for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000]
    for sign in ".)|":
        words = [c + sign for c in letters]
        want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(words, add_special_tokens=False)]
        assert packing.encode(words, path) == want


@pytest.mark.parametrize("seed", range(5))
def test_html_neighbours(seed):
    """The second pass against a search from every open block."""
    rng = random.Random(seed)
    words = {"good": "it is of the and to be in a that was as we are for the " * 5, "bad": "<a href=x>zug kal mip</a>", "open": "zug kal"}
    kinds = rng.choices(list(words), [1, 1, 2], k=40)
    blocks = html_text.blocks_of("".join(f"<p>{words[k]}</p>" for k in kinds))
    html_text.classify(blocks)
    decided = [i for i, k in enumerate(kinds) if k != "open"]
    for i, (b, k) in enumerate(zip(blocks, kinds)):
        near = min(decided, key=lambda j: (abs(j - i), j), default=None)
        assert b.label == (html_text.BAD if near is not None and kinds[near] == "bad" else html_text.GOOD)


def first_rules(b, whole):
    """The first pass's rules, one after another, for one block."""
    words = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", b.text.lower())
    stops = len([w for w in words if w in html_text.STOP_WORDS]) / max(1, len(words))
    linked = len(" ".join("".join(b.linked).split())) / max(1, len(b.text))
    bonus = 0.3 if b.main else -1.0 if whole else 0.0
    if b.aside or linked > 0.5:
        return 0
    if not b.main and len(b.text) < 200 and re.match("©|copyright", b.text, re.I):
        return 0
    if whole and not b.main:
        return 0
    if b.heading:
        return 1 if b.heading == 1 and not whole else None
    if len(b.text) < 70:
        return 0 if linked > 0.3 else None
    if stops + bonus >= 0.3:
        return 1
    return 1 if len(b.text) > 200 and (not whole or stops + bonus >= 0.2) else None


@pytest.mark.parametrize("seed", range(6))
def test_html_first_pass(seed):
    rng = random.Random(seed)
    parts = ["it is of the", "zug kal mip tor", "<a href=x>link of it</a>", "© us of it", "und das ist", "%%% la%%% 123"]
    tags = ["p", "h1", "h2", "div", "li", 'div class="ad"', "nav", "footer", "td"]
    body = ""
    for _ in range(60):
        tag = rng.choice(tags)
        body += f"<{tag}>{' '.join(rng.choices(parts, k=rng.choice([1, 2, 8, 30])))}</{tag.split()[0]}>"
        if seed % 2 and rng.random() < 0.1:
            body += "<article>" if "<article>" not in body else ""
    blocks = html_text.blocks_of(body)
    whole = any(b.main and not b.aside for b in blocks)
    assert html_text.first_pass(blocks) == [first_rules(b, whole) for b in blocks]


def test_html_without_containers(spark):
    """With no element that says what it is, the density rules agree with the marked pages."""
    shares = []
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        bare = re.sub(r"<(/?)(?:article|main|aside|nav|header|footer|section|menu|form)\b", r"<\1div", r["html"])
        bare = re.sub(r"\s(?:class|id|role|itemprop|style|hidden|aria-[a-z]+)(?:=(?:\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/>])", "", bare)
        one, two = ({b for b in html_text.main_text(x).split("\n\n")} for x in (r["html"], bare))
        shares.append(len(one & two) / max(1, len(one | two)))
    assert len(shares) > 100 and sum(shares) / len(shares) >= 0.95


def test_html_of_nothing_and_of_much(spark):
    pages = spark.createDataFrame([(1, "<article>" + "<p>So it was, and so it is.</p>" * 20_000 + "</article>")], "page_id long, html string")
    assert html_text.extract_text(pages.limit(0)).count() == 0
    assert len(html_text.extract_text(pages).first()["text"]) == 26 * 20_000 - 2


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (2, "<p>Only text", None)], "page_id long, html string, Text string")
    out = html_text.extract_text(pages).collect()
    assert sorted(r["text"] for r in out) == ["", "", "Only text"] and set(out[0].asDict()) == {"page_id", "html", "text"}


def test_mixing(docs, empty, spark):
    assert mixing.mix_sources(empty).documents.count() == 0
    assert mixing.take_copies(empty).count() == 0
    a = mixing.mix_sources(docs, block_words=16).documents.toPandas()
    b = mixing.mix_sources(docs.repartition(5), block_words=16).documents.toPandas()
    cols = ["id", "size", "source", "taken", "target"]
    a, b = (x[cols].fillna("-").astype(str).sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert a.equals(b)
    rows = corpus()
    assert len(a) == len(rows)
    size = {}
    for r in rows:
        size[r[2]] = size.get(r[2], 0) + len(WORD.findall(r[1] or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    cap, total, target, free = {s: 3 * size[s] for s in names}, sum(size.values()), {}, set(names)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if cap[s] < weight[s] * level}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: cap[s] for s in over}
        free -= over
    got = mixing.mix_sources(docs, block_words=16).documents.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target")).collect()
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and abs(r["t"] - target[r["source"]]) <= 1
    assert (mixing.mix_sources(docs).documents.where("taken > 3 * size").count()) == 0


def test_mixing_without_words(spark):
    out = mixing.mix_sources(spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")).documents.collect()
    assert [r["taken"] for r in out] == [0, 0] and all(r["target"] == 0 for r in out)


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    assert token_counts.count_tokens(empty, path).count() == 0
    library = Tokenizer.from_file(path)
    for r in token_counts.count_tokens(docs, path).collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 1024)


@pytest.mark.parametrize("seed", range(4))
def test_token_counts_of_odd_strings(seed):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library, machine, rng = Tokenizer.from_file(path), token_counts.transducer(path), random.Random(seed)
    signs = ["a", "'", "'s", "'re", "'l", " ", "  ", "\n", "12", "!", "é", "日", "　", "<|endoftext|>", "the", "\x85", "\x1c", "\U0001f600"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 300))) for _ in range(300)]
    assert machine.counts(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_composed_maps_equal_a_walk():
    rng = np.random.default_rng(1)
    maps = rng.integers(0, 11, (37, 11)).astype(np.uint8)
    walk, want = np.arange(11), []
    for m in maps:
        walk = m[walk]
        want.append(walk)
    assert (token_counts.compose_scan(maps) == np.array(want)).all()


def test_quality(docs, empty, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (61, None), (62, 0), (62, 1), (63, 7)], "doc_id long, quality int")
    net = quality.fit_quality(docs, labels, steps=5)
    out = quality.score_quality(docs, net).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out) and len(out) == docs.count()
    assert quality.score_quality(empty, net).count() == 0
    assert len(quality.score_quality(docs, quality.fit_quality(empty, labels)).take(1)) == 1


def test_quality_scores_by_a_plain_pass():
    """The network's scores against sums written out for every chunk, place and filter; training cuts chunks of both labels alike."""
    rng = np.random.default_rng(4)
    net = quality.train(rng.integers(1, 255, (30, quality.CHUNK)).astype(np.uint8), np.arange(30) % 2, steps=2)
    net.mix = np.array([0.5, 0.3, 0.2, 0.1])
    for size in (0, 5, quality.CHUNK, quality.CHUNK + 1, 1200):
        raw = rng.integers(0, 256, size).astype(np.uint8).tobytes()
        starts = [0]
        while starts[-1] + quality.CHUNK < size:
            starts.append(starts[-1] + quality.STRIDE)
        logits = []
        for at in starts:
            chunk = raw[at : at + quality.CHUNK].ljust(quality.CHUNK, b"\0")
            letters = [net.embed[c] for c in chunk]
            places = [np.concatenate(letters[i : i + quality.WIDTH]) @ net.conv for i in range(quality.CHUNK - quality.WIDTH + 1)]
            hidden = np.maximum(np.maximum(np.max(places, 0) + net.bias, 0) @ net.w1 + net.b1, 0)
            logits.append(float((hidden @ net.w2)[0] + net.b2[0]))
        value = 0.5 * sum(logits) / len(logits) + 0.3 * max(logits) + 0.2 * min(logits) + 0.1
        assert abs(net.document_scores([raw])[0] - 1 / (1 + np.exp(-value))) < 1e-5, size


def test_equal_texts_have_equal_quality():
    net, rng = quality.train(np.random.default_rng(1).integers(1, 255, (40, quality.CHUNK)).astype(np.uint8), np.arange(40) % 2, steps=3), random.Random(1)
    texts = [bytes(rng.choices(range(32, 127), k=rng.randint(0, 3000))) for _ in range(60)]
    mixed = [(k, texts[k]) for k in rng.choices(range(60), k=300)]
    scores = net.document_scores([t for _, t in mixed])
    assert len({(k, v) for (k, _), v in zip(mixed, scores.tolist())}) == len({k for k, _ in mixed})


def test_quality_takes_whole_rows_within_its_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i, chr(97 + i % 26) * (3000 if i % 10 else 90_000)) for i in range(60)], "doc_id long, text string")
    labels, seen = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int"), []
    monkeypatch.setattr(quality, "train", lambda chunks, y, *a, f=quality.train: seen.append((chunks, y)) or f(chunks, y, 2))
    quality.fit_quality(docs, labels, label_chunks=200)
    chunks, y = seen[0]
    assert len(chunks) % quality.n_chunks(3000) == 0 and 0 < (y == 0).sum() <= 200 and 0 < (y == 1).sum() <= 200


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.query(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (out.predicted == out.quality).mean() > 0.93


def test_chunks_cover_everything():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        text = bytes(random.Random(n).choices(range(1, 256), k=n))
        rows = quality.cut([text])
        assert len(rows) == quality.n_chunks(n)
        joined = rows[0].tobytes() + b"".join(r[quality.CHUNK - quality.STRIDE :].tobytes() for r in rows[1:])
        assert joined.rstrip(b"\0") == text


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 16))
    x = np.concatenate([c + rng.normal(0, 0.08, (30, 16)) for c in centers] + [rng.normal(size=(40, 16))])
    x[5] = x[6] = x[4] * 2
    rows = [(i, [float(np.float32(v)) for v in e], i % 2) for i, e in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [1.0, None] * 8, 1), (903, [float("nan")] * 16, 1), (904, [1.0] * 16, None), (905, [], 1), (906, [1.0, 2.0], 1), rows[3]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("links", F.lit("x")).repartition(4)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    v = np.array([r[1] for r in rows], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = (v @ v.T >= 0.98) & (np.arange(len(v))[:, None] % 2 == np.arange(len(v)) % 2)
    np.fill_diagonal(near, False)
    label = embedding_dedup._stars(np.arange(len(v)), near)
    assert sum(got[i]["n_links"] for i in range(len(v))) >= 0.98 * near.sum()
    assert all(got[i]["n_links"] <= near[i].sum() for i in range(len(v)))
    assert np.mean([got[i]["component_id"] == label[i] for i in range(len(v))]) > 0.97
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(900, 907))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_any_label(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, [1.0, 0.0], "b"), (4, None, "a"), (5, [1.0, 0.01], "a")]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (0, 4), 5: (2, 1)}


def test_tables_keep_the_recall():
    for bits in (12, 16, 20):
        one = (1 - np.arccos(0.98) / np.pi) ** bits
        assert 1 - (1 - one) ** embedding_dedup.tables_for(bits, 0.98) >= embedding_dedup.RECALL
    assert embedding_dedup.tables_for(12, 0.98) == 12


def test_embedding_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=16) + rng.normal(0, 0.1, (150, 16))
    df = spark.createDataFrame([(i, e.tolist(), 0) for i, e in enumerate(x)], "vec_id long, embedding array<double>, label int")
    whole = sorted(map(tuple, embedding_dedup.near_duplicates(df).drop("embedding").collect()))
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df).drop("embedding").collect())) == whole


def test_lm_scoring(docs, empty):
    out = lm_scoring.score_texts(docs).collect()
    for r in out:
        assert r["n_tokens"] == len(WORD.findall(r["text"] or ""))
        assert (r["perplexity"] is None) == (r["n_tokens"] == 0) and r["log_likelihood"] <= 0
    assert len({(r["text"], r["log_likelihood"]) for r in out}) == len({r["text"] for r in out})
    assert lm_scoring.score_texts(empty).count() == 0


@pytest.mark.parametrize("head", [0, 60, 1 << 16])
def test_lm_words_within_their_class(spark, monkeypatch, head):
    """The likelihood against the classes' and the words' shares, with any part of the words joined in Spark."""
    monkeypatch.setattr(lm_scoring, "HEAD", head)
    rng = random.Random(3)
    texts = [" ".join(f"w{int(rng.paretovariate(0.3))}" for _ in range(rng.randint(1, 40))) for _ in range(80)]
    texts += [texts[0]] * 5 + [None, "", texts[1].upper()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").repartition(3)
    nets = []
    monkeypatch.setattr(lm_scoring, "fit_window_net", lambda *a, f=lm_scoring.fit_window_net, **b: nets.append(f(*a, **b)) or nets[-1])
    got = {r["i"]: r["log_likelihood"] for r in lm_scoring.score_texts(df).collect()}
    words = [lower(t).split() for t in texts]
    n = {}
    for w in sum(words, []):
        n[w] = n.get(w, 0) + 1
    key = {w: int(lm_scoring.word_hashes(w.encode())[0][0]) for w in n}
    common = sorted(sorted(n, key=lambda w: (-n[w], (key[w] + 2**63) % 2**64))[: lm_scoring.COMMON], key=key.get)
    kind = {w: common.index(w) if w in common else lm_scoring.COMMON + key[w] % lm_scoring.HASHED for w in n}
    total = {k: sum(n[w] for w in n if kind[w] == k) for k in set(kind.values())}
    net = lm_scoring.WindowNet.unpack(nets[0].pack())
    for i, ws in enumerate(words):
        k = [lm_scoring.EDGE] * 2 + [kind[w] for w in ws] + [lm_scoring.EDGE] * 2
        want = sum(net.log_probabilities(np.array([[k[j], k[j + 1], k[j + 3], k[j + 4]]]), np.array([k[j + 2]]))[0] + np.log(n[w] / total[kind[w]]) for j, w in enumerate(ws))
        assert abs(got[i] - want) < 1e-4
    assert got[0] == got[80] == got[84] and got[1] == got[len(texts) - 1]


def test_every_token_is_a_target_once(docs, monkeypatch):
    texts, taught = docs.select(F.coalesce("text", F.lit("")).alias("text")).coalesce(1), []

    def spy(df):
        out = checkpointed(df)
        taught.append(out.agg(F.sum("n")).first()[0])
        return out

    monkeypatch.setattr(lm_scoring, "checkpointed", spy)
    lm_scoring.fit_window_net(texts, np.zeros(0, np.uint64))
    assert sum(taught) == sum(len(WORD.findall(r[1] or "")) for r in corpus())


def test_lm_knows_more_than_word_counts(spark):
    """On documents whose ids it never saw, a token is likelier by its neighbours than by its share of the corpus."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").dropDuplicates(["text"])
    seen, unseen = docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0")
    words = lm_scoring.vocabulary(seen.select(F.coalesce("text", F.lit("")).alias("text")))
    net = lm_scoring.fit_window_net(seen.select(F.coalesce("text", F.lit("")).alias("text")), words.common)
    texts = [(r[0] or "").encode() for r in unseen.select("text").collect()]
    kinds, _, _ = lm_scoring._joined(texts, words.common)
    at = np.flatnonzero(kinds != lm_scoring.EDGE)
    shares = np.bincount(lm_scoring._joined([(r[0] or "").encode() for r in seen.select("text").collect()], words.common)[0], minlength=lm_scoring.EDGE + 1)[: lm_scoring.EDGE] + 1
    shares = np.log(shares / shares.sum())
    assert net.log_probabilities(kinds[at[:, None] + np.array(lm_scoring.WINDOW)], kinds[at]).mean() > shares[kinds[at]].mean() + 0.1


def test_scores_do_not_hang_on_the_place():
    net, rng = lm_scoring.WindowNet.fresh(1), np.random.default_rng(0)
    context, target = rng.integers(0, lm_scoring.EDGE + 1, (1500, 4)), rng.integers(0, lm_scoring.EDGE, 1500)
    whole = net.log_probabilities(context, target)
    for k in range(0, 1500, 7):
        assert net.log_probabilities(context[k : k + 1 + k % 5], target[k : k + 1 + k % 5])[0] == whole[k]


def test_probabilities_sum_to_one():
    net = lm_scoring.WindowNet.fresh(1)
    context = np.random.default_rng(0).integers(0, lm_scoring.EDGE + 1, (1, 4))
    p = [np.exp(net.log_probabilities(context, np.array([t])))[0] for t in range(lm_scoring.EDGE)]
    assert abs(sum(p) - 1) < 1e-4
    again = lm_scoring.WindowNet.unpack(net.pack())
    assert (again.w2 == net.w2).all()


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    up = {i: i for i in sets}

    def root(a):
        return a if up[a] == a else root(up[a])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_jaccard(docs, empty):
    assert jaccard_join.jaccard_components(empty).count() == 0
    got = jaccard_join.jaccard_components(docs).collect()
    want = brute_components([(r[0], r[1]) for r in corpus() if r[0] is not None])
    assert len(got) == len(corpus())
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]


@pytest.mark.parametrize("block", [3, 2048])
def test_jaccard_group_of_near_copies(spark, monkeypatch, block):
    rng = random.Random(block)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), fragments=3).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    assert packing.pack_documents(empty, path).count() == 0
    library = Tokenizer.from_file(path)
    want = []
    for r in corpus():
        ids = np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(r[0], k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64)]
    out = packing.pack_documents(docs, path, 64).toPandas()
    key = lambda x: tuple(-1 if v is None or v != v else int(v) for v in x)
    assert sorted(map(key, out.iloc[:, :5].itertuples(index=False))) == sorted(map(key, want))
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 64
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 64) * 1.05 + 1


@pytest.mark.parametrize("seed", range(30))
def test_brackets(seed):
    """Partners against a stack, in one range, and in many ranges whose rests meet by number."""
    rng = random.Random(seed)
    sides = [rng.randrange(2) if seed % 3 else int(rng.random() < rng.choice([0.2, 0.8])) for _ in range(rng.randrange(1, 80))]
    want, stack = [-1] * len(sides), []
    for i, side in enumerate(sides):
        if side == 0:
            stack.append(i)
        elif stack:
            j = stack.pop()
            want[i], want[j] = j, i
    assert packing.bracket(np.array(sides)).tolist() == want
    cuts = sorted(rng.sample(range(len(sides) + 1), min(len(sides), rng.randrange(5))))
    ranges = [range(x, y) for x, y in zip([0, *cuts], [*cuts, len(sides)])]
    got, counts, places = [-1] * len(sides), {}, {}
    for r, inside in enumerate(ranges):
        mates = packing.bracket(np.array([sides[i] for i in inside], int)) if len(inside) else []
        for i, m in zip(inside, mates):
            if m >= 0:
                got[i] = inside[m]
            else:
                k = counts[r, sides[i]] = counts.get((r, sides[i]), 0) + 1
                places[r, sides[i], k - 1] = i
    numbers = set()
    for from_, first, last, to, at, number in packing.carried(counts, len(ranges)):
        for k in range(last - first):
            i, j = places[from_, 0, last - 1 - k], places[to, 1, at + k]
            got[i], got[j] = j, i
            assert number + k not in numbers
            numbers.add(number + k)
    assert got == want


@pytest.mark.parametrize("seed, rows", [(0, 100_000), (1, 40), (2, 7), (3, 100_000)])
def test_supersteps(spark, seed, rows, monkeypatch):
    """Every piece has its place, sequences are full without gaps, and few more than the tokens need; over any number of ranges."""
    monkeypatch.setattr(packing, "RANGE_ROWS", rows)
    rng = random.Random(seed)
    capacity = (64, 64, 10, 257)[seed]
    lengths = [min(capacity, max(1, int(rng.expovariate(6 / capacity)))) for _ in range(300)] + [capacity // 2 + 1] * 40 + [1] * 60
    pieces = spark.createDataFrame([(None if k % 50 == 0 else k % 7, k, n) for k, n in enumerate(lengths)], "doc_id long, piece int, length long")
    out = packing.pack(pieces, capacity).toPandas()
    assert sorted(out.piece) == list(range(len(lengths))) and all(lengths[p] == n for p, n in zip(out.piece, out.length))
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= capacity
    gaps: list[int] = []  # best fit, longest first, one piece after another
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps[gaps.index(fit)] -= n
    assert out.sequence_id.nunique() <= 1.02 * len(gaps) + 2


def test_ogg(docs, empty):
    for r in ogg_media.encode_media(docs).withColumn("r", ogg_media.decode_media(F.col("media"))).collect():
        raw = (r["text"] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["r"]["payload_bytes"], r["r"]["payload_sha256"], r["r"]["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert ogg_media.encode_media(empty).count() == 0


def test_ogg_damage_is_found():
    data = bytearray(ogg_media.write_ogg(bytes(range(256)) * 900))
    pages = list(ogg_media.read_pages(bytes(data)))
    assert len(pages) > 5 and {p[2] for p in pages} == {ogg_media.SAMPLES, ogg_media.INDEX}
    data[len(data) // 2] ^= 1
    with pytest.raises(ogg_media.OggError):
        ogg_media.read_ogg(bytes(data))


def test_ogg_timestamps():
    packets = ogg_media.read_ogg(ogg_media.write_ogg(b"\x80" * 200_016))[ogg_media.SAMPLES][1:]
    ends = np.cumsum([len(p) for p, _ in packets]) / ogg_media.RATE
    assert np.allclose(ogg_media.timestamps(packets, ogg_media.RATE), ends)
