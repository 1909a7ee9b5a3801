"""The operators' queries, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from retort.llm import (
    chat_format, decontamination, divergence_audit, importance_resampling, licenses, near_dedup, packing, quality_classifier, quality_rules, secret_scan, sharding, token_counts, token_files,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_subword_quality_classifier": quality_classifier.query,
    "op2_differencing_packing": packing.query,
    "op3_license_digests": licenses.query,
    "op4_minhash_near_dedup": near_dedup.query,
    "op5_structural_secret_scan": secret_scan.query,
    "op6_transcript_hmm": chat_format.query,
    "op7_risk_controlled_rules": quality_rules.query,
    "op8_seeded_alignment_decontamination": decontamination.query,
    "op9_extendible_sharding": sharding.query,
    "op10_rans_token_files": token_files.query,
    "op11_digest_cached_token_counts": token_counts.query,
    "op12_segment_importance_resampling": importance_resampling.query,
    "op13_digest_divergence_audit": divergence_audit.query,
}

ORACLES: dict[str, str] = {
    "op3_license_digests": licenses.ORACLE,
    "op9_extendible_sharding": sharding.ORACLE,
    "op13_digest_divergence_audit": divergence_audit.ORACLE,
}
