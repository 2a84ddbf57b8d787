"""The corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import alignment, filter_audit, fingerprints, line_dedup, lm, mixing, packing, pii, quality, sharding, simhash_dedup, substring_dedup, vector_dedup

_QUERIES = (
    line_dedup.op1_line_dedup,
    lm.op2_language_model,
    fingerprints.op3_fingerprints,
    sharding.op4_resharding,
    vector_dedup.op5_vector_near_dedup,
    simhash_dedup.op6_simhash_near_dedup,
    quality.op7_quality_classifier,
    substring_dedup.op8_substring_dedup,
    mixing.op9_mixing,
    packing.op10_packing,
    pii.op11_personal_data,
    alignment.op12_token_alignment,
    filter_audit.op13_filter_audit,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {f.__name__: f for f in _QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op5_vector_near_dedup": vector_dedup.SQL, "op8_substring_dedup": substring_dedup.SQL, "op13_filter_audit": filter_audit.SQL}
