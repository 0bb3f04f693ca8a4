"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from palimpsest.llm import archives, byte_bpe, html_text, language_id, mixing, ngram_join, quality, secret_scan, token_counts, topk_search


def queries() -> dict:
    found = (
        token_counts.op1_token_counts,
        secret_scan.op2_secret_scan,
        quality.op3_quality,
        html_text.op4_html_text,
        mixing.op5_mixing,
        byte_bpe.op6_byte_bpe,
        ngram_join.op7_ngram_join,
        archives.op8_warc,
        topk_search.op9_topk_search,
        language_id.op10_language_id,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secret_scan": secret_scan.oracle(),
        "op5_mixing": mixing.ORACLE,
        "op7_ngram_join": ngram_join.ORACLE,
        "op8_warc": archives.oracle(),
        "op9_topk_search": topk_search.ORACLE,
    }
