"""Queries of this subpackage over the given tables, and their DuckDB twins where SQL has one."""

from __future__ import annotations

from visitlens.llm import (ann, bpe, divergence, html_text, importance, mixing, ngram_join, quality_classifier, quality_rules,
                           sharding, toxicity, url_filter, warc)

QUERIES = {
    "op1_warc_archive": warc.op1_warc_archive,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_shard": sharding.op3_shard,
    "op4_ann": ann.op4_ann,
    "op5_extract": html_text.op5_extract,
    "op6_mix": mixing.op6_mix,
    "op7_bpe": bpe.op7_bpe,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_importance_resampling": importance.op12_importance_resampling,
    "op13_toxicity": toxicity.op13_toxicity,
}
ORACLE_SQL = {
    "op1_warc_archive": warc.OP1_SQL,
    "op2_url_filter": url_filter.OP2_SQL,
    "op6_mix": mixing.OP6_SQL,
    "op10_quality_rules": quality_rules.OP10_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
}
