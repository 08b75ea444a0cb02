"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelfactor.llm import conversations, line_dedup, mixing, resampling, sql, token_files
from panelfactor.llm.decontamination import op8_decontamination
from panelfactor.llm.jaccard_join import op10_jaccard_join
from panelfactor.llm.media_ogg import op3_media_ogg
from panelfactor.llm.pii import op2_pii
from panelfactor.llm.quality_classifier import op6_quality_classifier
from panelfactor.llm.secret_scan import op4_secret_scan
from panelfactor.llm.substring_dedup import op5_substring_dedup
from panelfactor.llm.token_counts import op9_token_counts

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_pii": op2_pii,
        "op3_media_ogg": op3_media_ogg,
        "op4_secret_scan": op4_secret_scan,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_mixing": mixing.op7_mixing,
        "op8_decontamination": op8_decontamination,
        "op9_token_counts": op9_token_counts,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_conversations": conversations.op11_conversations,
        "op12_token_files": token_files.op12_token_files,
        "op13_resampling": resampling.op13_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.SQL,
        "op5_substring_dedup": sql.SUBSTRING_DEDUP,
        "op7_mixing": mixing.SQL,
        "op8_decontamination": sql.DECONTAMINATION,
        "op10_jaccard_join": sql.JACCARD_JOIN,
        "op11_conversations": conversations.SQL,
        "op13_resampling": resampling.SQL,
    }
