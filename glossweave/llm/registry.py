"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from glossweave.llm import exact_dedup, line_dedup, minhash_dedup, mixing, packing, private_data, quality, recompression, sharding, simhash, suffix_dedup, token_alignment, whitening

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_simhash_fingerprints": simhash.op2_simhash_fingerprints,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_suffix_array_dedup": suffix_dedup.op4_suffix_array_dedup,
        "op5_sharding": sharding.op5_sharding,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_minhash_near_dedup": minhash_dedup.op7_minhash_near_dedup,
        "op8_substring_dedup": recompression.op8_substring_dedup,
        "op9_mixing_sources": mixing.op9_mixing_sources,
        "op10_quality_classifier": quality.op10_quality_classifier,
        "op11_token_alignment": token_alignment.op11_token_alignment,
        "op12_personal_data": private_data.op12_personal_data,
        "op13_embedding_whitening": whitening.op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.OP1_SQL,
        "op4_suffix_array_dedup": suffix_dedup.OP4_SQL,
        "op6_line_dedup": line_dedup.OP6_SQL,
        "op7_minhash_near_dedup": minhash_dedup.OP7_SQL,
        "op8_substring_dedup": recompression.OP8_SQL,
        "op9_mixing_sources": mixing.OP9_SQL,
    }
