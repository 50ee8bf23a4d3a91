"""The queries of this subpackage, for the driver's registry."""

from __future__ import annotations

from . import bpe, jaccard_join, mixing, pii, quality_classifier, quality_rules, sharding, substring_dedup, topk, url_trust

QUERIES = {
    "op1_url_trust": url_trust.op1_url_trust,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_mixing": mixing.op3_mixing,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_pii": pii.op5_pii,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_sharding": sharding.op8_sharding,
    "op9_bpe": bpe.op9_bpe,
    "op10_topk": topk.op10_topk,
}

ORACLE = {
    "op1_url_trust": url_trust.SQL,
    "op2_quality_rules": quality_rules.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op10_topk": topk.SQL,
}
