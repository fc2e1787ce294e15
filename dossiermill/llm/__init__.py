"""Operations for large training-data pipelines, and their registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontamination, hard_negatives, language_id, license_scan, line_runs, mixing, order_minhash, repeats, sharding, simhash, token_files, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_shard_by_bytes": sharding.op1_shard_by_bytes,
        "op2_language_id": language_id.op2_language_id,
        "op3_decontamination": decontamination.op3_decontamination,
        "op4_suffix_dedup": repeats.op4_suffix_dedup,
        "op5_mix_sources": mixing.op5_mix_sources,
        "op6_license_scan": license_scan.op6_license_scan,
        "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
        "op8_line_dedup": line_runs.op8_line_dedup,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_order_minhash": order_minhash.op10_order_minhash,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_token_files": token_files.op12_token_files,
        "op13_tokenizer_alignment": alignment.op13_tokenizer_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontamination": decontamination.OP3_SQL,
        "op6_license_scan": license_scan.OP6_SQL,
        "op8_line_dedup": line_runs.OP8_SQL,
        "op11_hard_negatives": hard_negatives.OP11_SQL,
    }
