"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from spanloom.llm import exact, lines, minhash, mixing, packing, quality_model, quality_rules, secrets, sharding, substrings


def queries() -> dict:
    return {
        "op1_exact_dedup": exact.query,
        "op2_line_dedup": lines.query,
        "op3_minhash_near_dedup": minhash.query,
        "op4_sharding": sharding.query,
        "op5_mixing": mixing.query,
        "op6_packing": packing.query,
        "op7_quality_classifier": quality_model.query,
        "op8_quality_rules": quality_rules.query,
        "op9_substring_dedup": substrings.query,
        "op10_secret_scans": secrets.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact.ORACLE, "op8_quality_rules": quality_rules.ORACLE}
