"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kgspark.llm import ann, bpe, licenses, lm_scoring, near_dedup, packing, quality, substring_dedup, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_deleted_interpolation": lm_scoring.op2_deleted_interpolation,
        "op3_ann_projections_kdtree": ann.op3_ann_projections_kdtree,
        "op4_quality_bradley_terry": quality.op4_quality_bradley_terry,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_topk_inner_products": topk.op6_topk_inner_products,
        "op7_near_dedup_dartminhash": near_dedup.op7_near_dedup_dartminhash,
        "op8_packing_min_slack": packing.op8_packing_min_slack,
        "op9_toxicity_zstd": toxicity.op9_toxicity_zstd,
        "op10_bpe_trie": bpe.op10_bpe_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_topk_inner_products": topk.OP6_SQL}
