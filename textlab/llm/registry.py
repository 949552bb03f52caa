"""The subpackage's queries and the SQL that states the same results, by name."""

from __future__ import annotations

from . import html_text, importance, language_id, neardup, pii, quality_rules, sentencepiece_codec, sharding, toxicity, winnowing

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_toxicity": toxicity.query,
    "op3_sentencepiece": sentencepiece_codec.query,
    "op4_pii": pii.query,
    "op5_decontaminate": winnowing.query,
    "op6_quality_rules": quality_rules.query,
    "op7_sharding": sharding.query,
    "op8_setsketch": neardup.query,
    "op9_html": html_text.query,
    "op10_importance_resampling": importance.query,
}
ORACLES = {"op5_decontaminate": winnowing.ORACLE, "op8_setsketch": neardup.ORACLE}
