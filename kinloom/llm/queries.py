"""The queries of the corpus operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinloom.llm import collocations, conversation_repair, embedding_dedup, html_text, jaccard_join, line_dedup, lm_scoring, mixing, ogg_media, packing, quality, token_counts, warc
from kinloom.session import ship

_MODULES = {
    "op1_line_dedup": line_dedup,
    "op2_html_extraction": html_text,
    "op3_source_mixing": mixing,
    "op4_token_counts": token_counts,
    "op5_quality_classifier": quality,
    "op6_embedding_near_dedup": embedding_dedup,
    "op7_lm_scoring": lm_scoring,
    "op8_ngram_jaccard_join": jaccard_join,
    "op9_best_fit_packing": packing,
    "op10_ogg_media": ogg_media,
    "op11_phrase_collocations": collocations,
    "op12_conversation_repair": conversation_repair,
    "op13_warc_conversion": warc,
}


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(ship(spark), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(module.query) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _MODULES.items() if hasattr(module, "SQL")}
