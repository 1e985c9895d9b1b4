"""The training-data queries and their SQL; the pipeline is registered beside them from its own module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bloom_lm as op4
from . import jaccard_join as op5
from . import line_crf as op1
from . import multi_index as op3
from . import packing as op2
from . import pii as op9
from . import quality_rules as op8
from . import sentencepiece_scan as op6
from . import sharding as op7
from . import suffix_dedup as op10


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_crf": op1.op1_line_crf,
        "op2_packing": op2.op2_packing,
        "op3_multi_index": op3.op3_multi_index,
        "op4_bloom_lm": op4.op4_bloom_lm,
        "op5_jaccard_join": op5.op5_jaccard_join,
        "op6_sentencepiece": op6.op6_sentencepiece,
        "op7_sharding": op7.op7_sharding,
        "op8_quality_rules": op8.op8_quality_rules,
        "op9_pii": op9.op9_pii,
        "op10_suffix_dedup": op10.op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_jaccard_join": op5.OP5_SQL, "op8_quality_rules": op8.OP8_SQL, "op10_suffix_dedup": op10.OP10_SQL}
