"""The queries over the operators of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, html_text, lm_score, mixing, near_dedup, perplexity, quality, quotes, spelling, topk, url_filter, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": topk.op1_topk,
    "op2_lm_score": lm_score.op2_lm_score,
    "op3_mixing": mixing.op3_mixing,
    "op4_quotes": quotes.op4_quotes,
    "op5_bpe": bpe.op5_bpe,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_quality": quality.op7_quality,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_urls": url_filter.op9_urls,
    "op10_html": html_text.op10_html,
    "op11_rules": perplexity.op11_rules,
    "op12_spelling": spelling.op12_spelling,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk": topk.OP1_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
}
