"""Queries of this folder by name, and their SQL where SQL can express them."""

from __future__ import annotations

from labelway.llm import (
    attribution,
    fptree,
    html,
    langid,
    neardup,
    packing,
    quality,
    pieces,
    simhash,
    toxicity,
    warc,
    whitening,
    winnow,
)

QUERIES = {
    "op1_sentencepiece": pieces.q_sentencepiece,
    "op2_packing": packing.q_packing,
    "op3_toxicity_crf": toxicity.q_toxicity_crf,
    "op4_html_text": html.q_html_text,
    "op5_order_minhash": neardup.q_order_minhash,
    "op6_token_attribution": attribution.q_token_attribution,
    "op7_quality_rules": quality.q_quality_rules,
    "op8_warc": warc.q_warc,
    "op9_winnowing": winnow.q_winnowing,
    "op10_language_id": langid.q_language_id,
    "op11_simhash": simhash.q_simhash,
    "op12_lexical_search": fptree.q_lexical_search,
    "op13_whitening": whitening.q_whitening,
}

ORACLE_SQL: dict[str, str] = {"op12_lexical_search": fptree.LEXICAL_SQL}
