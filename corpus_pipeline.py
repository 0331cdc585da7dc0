"""A corpus from raw documents to packed sequences.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir) and returns a
frame.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kinloom.llm import jaccard_join, line_dedup, mixing, packing, quality
from kinloom.operators.recovery import checkpointed
from kinloom.session import ship

#: The stages' rows depend on a trained network and a tokenizer, which SQL lacks.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, trained on the labels not held out; a null text is scored as an empty one."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out())
    net = quality.fit_quality(docs, labels)
    return quality.score_quality(docs, net).where("predicted = 1").select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller id holds; ``n_chars`` follows the text, which is empty where it was null."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of every group of near duplicates.

    Rows that repeat an id become the one with the greatest text; rows without
    an id, and texts without words, are groups of their own.
    """
    out = jaccard_join.jaccard_components(docs).where("component_id is null or component_id = doc_id").select(*docs.columns)
    named = docs.where("doc_id is not null").select("doc_id")
    if named.groupBy("doc_id").count().where("count > 1").limit(1).count():
        order = Window.partitionBy("doc_id").orderBy(F.desc("text"), F.xxhash64(*docs.columns))
        one = out.where("doc_id is not null").withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
        out = one.unionByName(out.where("doc_id is null"))
    return out


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole; one without words is not taken."""
    return mixing.take_copies(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, placed in sequences of at most 2048 tokens; copies are packed as documents of their own."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_shared_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources to target weights", mix_to_weights),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what one keeps is written before the next reads it."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
