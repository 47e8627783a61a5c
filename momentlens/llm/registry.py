"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from momentlens.llm import decontaminate, line_dedup, merkle_manifest, near_duplicates, ngram_score, packing, personal_data, quality_classifier, quality_rules, secrets, token_counts, toxicity, whitening


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.query,
        "op2_toxicity": toxicity.query,
        "op3_ngram_score": ngram_score.query,
        "op4_near_duplicates": near_duplicates.query,
        "op5_packing": packing.query,
        "op6_quality": quality_classifier.query,
        "op7_personal_data": personal_data.query,
        "op8_secrets": secrets.query,
        "op9_decontamination": decontaminate.query,
        "op10_quality_rules": quality_rules.query,
        "op11_whitening": whitening.query,
        "op12_line_dedup": line_dedup.query,
        "op13_merkle_manifest": merkle_manifest.query,
    }


def oracle_sql() -> dict:
    return {
        "op9_decontamination": decontaminate.ORACLE,
        "op10_quality_rules": quality_rules.oracle(),
        "op12_line_dedup": line_dedup.ORACLE,
        "op13_merkle_manifest": merkle_manifest.ORACLE,
    }
