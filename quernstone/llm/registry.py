"""The registered queries of the subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import bpe, chat, lm, minhash, mixing, quality, spotsigs, suffixes, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_crf_quality": quality.op1_line_crf_quality,
        "op2_boosted_toxicity": toxicity.op2_boosted_toxicity,
        "op3_spotsigs": spotsigs.op3_spotsigs,
        "op4_pivotal_mix": mixing.op4_pivotal_mix,
        "op5_minhash_near_dup": minhash.op5_minhash_near_dup,
        "op6_kd_top_k": topk.op6_kd_top_k,
        "op7_suffix_array_dedup": suffixes.op7_suffix_array_dedup,
        "op8_chat_format": chat.op8_chat_format,
        "op9_stupid_backoff": lm.op9_stupid_backoff,
        "op10_byte_bpe": bpe.op10_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_spotsigs": spotsigs.OP3_SQL,
        "op6_kd_top_k": topk.OP6_SQL,
        "op8_chat_format": chat.OP8_SQL,
        "op9_stupid_backoff": lm.OP9_SQL,
    }
