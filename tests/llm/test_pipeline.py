"""The pipeline's stages, each against brute force on what the stage before it kept."""

from collections import Counter

import pytest
from test_operators import WORD, brute_components, lower

import corpus_pipeline
from kinloom.llm import quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The rows before the first stage and after each, written and read again as the driver does."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [d.toPandas() for d in out]


def test_columns(kept):
    assert all(list(k.columns) == list(kept[0].columns) for k in kept[1:5])


def test_quality_keeps_what_it_accepts(spark, kept):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    scores = quality.score_quality(docs, quality.fitted(spark, SF)).toPandas()
    assert sorted(kept[1].doc_id) == sorted(scores.doc_id[scores.predicted == 1])


def test_lines(kept):
    first, docs = {}, {}
    rows = sorted(zip(kept[1].doc_id, kept[1].text.fillna("")))
    for i, t in rows:
        for k in {lower(x.strip(" \t\n\x0b\x0c\r")) for x in t.split("\n")}:
            first.setdefault(k, i)
            docs[k] = docs.get(k, 0) + 1
    want = {}
    for i, t in rows:
        want[i] = "\n".join(x for x in t.split("\n") if len(k := lower(x.strip(" \t\n\x0b\x0c\r"))) < 10 or docs[k] < 2 or first[k] == i)
    assert dict(zip(kept[2].doc_id, kept[2].text)) == want
    assert all(len(t) == n for t, n in zip(kept[2].text, kept[2].n_chars))


def test_one_of_each_group(kept):
    part = brute_components(list(zip(kept[2].doc_id, kept[2].text)))
    assert sorted(kept[3].doc_id) == sorted(i for i, (_, c) in part.items() if c == i)


def test_mix_takes_whole_documents(kept):
    size = {i: len(WORD.findall(t)) for i, t in zip(kept[3].doc_id, kept[3].text)}
    times = Counter(kept[4].doc_id)
    assert set(times) <= set(size) and all(1 <= k <= 3 and size[i] for i, k in times.items())
    source, total = dict(zip(kept[3].doc_id, kept[3].source)), sum(size.values())
    taken = Counter()
    for i, k in times.items():
        taken[source[i]] += k * size[i]
    assert abs(sum(taken.values()) - total) < 0.1 * total


def test_every_copy_is_packed(kept):
    packed = kept[5]
    assert Counter(packed.doc_id[packed.piece == 0]) == Counter(kept[4].doc_id)
    assert (packed.groupby("sequence_id").length.sum() <= 2048).all()
    assert packed.groupby("sequence_id").ngroups <= -(-packed.length.sum() // 2048) * 1.05 + 1
