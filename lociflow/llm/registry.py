"""Queries of the training-data operators and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op1_jaccard import op1_jaccard_join
from . import op2_multi_index, op4_bitsliced, op9_licenses
from .op3_suffix_dedup import op3_suffix_dedup
from .op5_byte_bpe import op5_byte_bpe
from .op6_packing import op6_packing
from .op7_toxicity import op7_toxicity
from .op8_token_files import op8_token_files
from .op10_secrets import op10_secret_scan

__all__ = ["oracle_sql", "queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_embedding_links": op2_multi_index.op2_embedding_links,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_bitsliced_topk": op4_bitsliced.op4_bitsliced_topk,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_packing": op6_packing,
        "op7_toxicity": op7_toxicity,
        "op8_token_files": op8_token_files,
        "op9_license_scan": op9_licenses.op9_license_scan,
        "op10_secret_scan": op10_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_links": op2_multi_index.ORACLE, "op4_bitsliced_topk": op4_bitsliced.ORACLE, "op9_license_scan": op9_licenses.ORACLE}
