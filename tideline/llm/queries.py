"""The registered queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import chat, exact_dedup, jaccard_join, packing, personal_data, quality, secrets, sentence_pieces, shards, telephony


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_telephony": telephony.telephony_query,
        "op2_personal_data": personal_data.personal_data_query,
        "op3_chat_format": chat.chat_query,
        "op4_jaccard_join": jaccard_join.jaccard_query,
        "op5_best_fit_packing": packing.pack_query,
        "op6_histogram_sort": shards.shard_query,
        "op7_quality": quality.quality_query,
        "op8_exact_dedup": exact_dedup.exact_dedup_query,
        "op9_sentence_pieces": sentence_pieces.sentence_pieces_query,
        "op10_secrets": secrets.secrets_query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": chat.CHAT_SQL, "op8_exact_dedup": exact_dedup.EXACT_DEDUP_SQL}
