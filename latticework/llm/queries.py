"""The operators' queries and their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, hard_negatives, html_extract, language_id, line_dedup, merkle, ngram_join, pii, quality_rules, score_index, sharding, token_file

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "quality_ablations": quality_rules.ablation_query,
    "op2_decontaminate": decontaminate.query,
    "op3_sharding": sharding.query,
    "op4_language_id": language_id.query,
    "op5_html_extract": html_extract.query,
    "op6_ngram_join": ngram_join.query,
    "op7_line_dedup": line_dedup.query,
    "op8_token_file": token_file.query,
    "op9_pii": pii.query,
    "op10_bpe": bpe.query,
    "op11_exact_top_k": score_index.query,
    "op12_merkle_manifest": merkle.query,
    "op13_hard_negatives": hard_negatives.query,
}

ORACLE_SQL = {
    "op1_quality_rules": quality_rules.SQL,
    "quality_ablations": quality_rules.ABLATION_SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op11_exact_top_k": score_index.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
