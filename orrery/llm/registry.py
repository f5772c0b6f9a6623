"""The queries of this subpackage, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, line_dedup, near_dedup, packing, pii, quality, sharding, tokens, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1_pii,
    "op2_jump_sharding": sharding.op2_sharding,
    "op3_packing": packing.op3_packing,
    "op4_quality_gam": quality.op4_quality_gam,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_token_counts": tokens.op8_token_counts,
    "op9_histogram_topk": topk.op9_histogram_topk,
    "op10_bpe": bpe.op10_bpe,
}

ORACLE_SQL: dict[str, str] = {"op7_exact_dedup": exact_dedup.OP7_SQL, "op9_histogram_topk": topk.OP9_SQL}
