"""Queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from corpusframe.llm import (
    collocations,
    exact_dedup,
    html_layout,
    license_scan,
    mixing,
    piece_bpe,
    quality_rules,
    secrets,
    sharding,
    simhash,
    suffix_dedup,
    token_counts,
    whitening,
)

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_simhash": simhash.query,
    "op3_license_scan": license_scan.query,
    "op4_mixing": mixing.query,
    "op5_secrets": secrets.query,
    "op6_piece_bpe": piece_bpe.query,
    "op7_html_layout": html_layout.query,
    "op8_suffix_dedup": suffix_dedup.query,
    "op9_quality_rules": quality_rules.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_collocations": collocations.query,
    "op12_whitening": whitening.query,
    "op13_sharding": sharding.query,
}

ORACLE = {
    "op4_mixing": mixing.ORACLE_SQL,
    "op5_secrets": secrets.oracle_sql(),
    "op9_quality_rules": quality_rules.oracle_sql(),
    "op10_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_collocations": collocations.oracle_sql(),
    "op13_sharding": sharding.oracle_sql(),
}
