"""Line dedup: lines that several documents share stay in one of them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinloom.llm.common import SPACE, ascii_lower, intake, outgo
from kinloom.operators.recovery import checkpointed


def _without(text: pa.Array, dropped: pa.Array) -> pa.Array:
    """The text's lines but those at the dropped positions."""
    out = []
    for one, positions in zip(text, dropped):
        lines, gone = one.as_py().split("\n"), set(positions.as_py() or ())
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return pa.array(out, pa.string())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Drop lines found in ``min_docs`` documents or more, except in the smallest id.

    A line's key is the line without white space at its ends and with A-Z in
    lower case; keys shorter than ``min_chars`` code points never count.  All
    columns come back with the text replaced, ``n_lines`` (before dropping)
    and ``n_dropped``.  Lines are exploded and hashed to 128 bits; only hashes,
    ids and positions are shuffled for the count, and one join by id brings the
    dropped positions to the texts.

    Texts and lines of any length are read whole; columns keep their names and
    values, but for those named like the outputs.  Null or empty text: one empty line.  Null id: the row is kept whole and
    counts as no document.  Rows that repeat an id are one document for the
    count, and each loses its own lines.  An empty table gives an empty one.
    """
    base, names = intake(docs, id_col, text_col)
    base = base.select("_rest", F.col("_w0").alias("_id"), F.coalesce("_w1", F.lit("")).alias("_text"))
    key = ascii_lower(F.btrim(F.col("_line"), F.lit(SPACE)))
    lines = (
        base.where("_id is not null")
        .select("_id", F.xxhash64("_text").alias("_tag"), F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
        .select("_id", "_tag", "_pos", key.alias("_key"))
        .where(F.length("_key") >= min_chars)
        .select("_id", "_tag", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(7), "_key").alias("_h2"))
    )
    if min_docs <= 2:  # two documents hold a key exactly when its least and greatest id differ
        counts = lines.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"))
        shared = counts.where(F.col("_first") < F.col("_last") if min_docs == 2 else F.lit(True))
    else:
        pairs = lines.select("_h1", "_h2", "_id").distinct()
        shared = pairs.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where(F.col("_n") >= min_docs)
    # Written apart from the join, so that the join can split a line that very many documents share.
    shared = checkpointed(shared.select("_h1", "_h2", "_first"))
    dropped = (
        lines.join(shared, ["_h1", "_h2"])
        .where(F.col("_id") > F.col("_first"))
        .groupBy("_id", "_tag")
        .agg(F.collect_set("_pos").alias("_dropped"))
    )
    joined = base.withColumn("_tag", F.xxhash64("_text")).join(dropped, ["_id", "_tag"], "left")
    kept = F.when(F.col("_dropped").isNull(), F.col("_text")).otherwise(F.arrow_udf(_without, "string")(F.col("_text"), F.col("_dropped")))
    return outgo(
        joined,
        names,
        {
            id_col: F.col("_id"),
            text_col: kept,
            "n_lines": (F.length("_text") - F.length(F.translate("_text", "\n", "")) + 1).cast("long"),
            "n_dropped": F.coalesce(F.size("_dropped"), F.lit(0)).cast("long"),
        },
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT keyed.*, (shared.k IS NOT NULL AND doc_id > first) AS gone
  FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
