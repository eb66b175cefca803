"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import OP8_SQL, op8_exact_dedup
from .media import op9_media
from .mixing import op1_mixing
from .near_dedup import OP6_SQL, op6_near_dedup
from .packing import op2_packing
from .quality import op4_quality
from .suffix_dedup import op3_suffix_dedup
from .token_counts import op7_token_counts
from .toxicity import op5_toxicity
from .training_order import op10_training_order


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_packing": op2_packing,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_quality": op4_quality,
        "op5_toxicity": op5_toxicity,
        "op6_near_dedup": op6_near_dedup,
        "op7_token_counts": op7_token_counts,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_media": op9_media,
        "op10_training_order": op10_training_order,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_near_dedup": OP6_SQL, "op8_exact_dedup": OP8_SQL}
