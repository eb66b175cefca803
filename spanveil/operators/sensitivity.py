"""The gate: does a text hold anything sensitive at all, as a language model sees it?

A backend's failure fails the task, so a text is never let through because nobody could be asked.  A null
or blank text is not sensitive.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PolicyError
from ..functions.fixed import GATE_CHUNK_CHARS
from ..functions.text import chunk_by_paragraph, parse_sensitivity
from ..plans.policy import Policy
from ..sources.backends import backend_of
from ..sources.prompts import sensitivity_prompt


def is_sensitive(df: DataFrame, policy: Policy, text_col: str = "text", out_col: str = "is_sensitive") -> DataFrame:
    """Adds whether any part of the text is sensitive; the first part that is settles it."""
    if not policy.llm.enabled:
        raise PolicyError("the gate needs a language model (with_llm)")
    make, language = backend_of(policy.llm), policy.llm.language

    @F.pandas_udf("boolean")
    def gate(texts: pd.Series) -> pd.Series:
        backend = make()
        ask = lambda part: parse_sensitivity(backend.complete(sensitivity_prompt(part, language)))
        return pd.Series([bool(t) and bool(t.strip()) and any(ask(part) for part, _ in chunk_by_paragraph(t, GATE_CHUNK_CHARS)) for t in texts])

    size = F.octet_length(text_col)
    checked = F.when(size > policy.max_text_bytes, F.raise_error(F.concat(F.lit("ValueError: Input text is too large: "), F.format_number(size, 0), F.lit(" bytes"))).cast("string")).otherwise(F.col(text_col))
    return df.withColumn(out_col, gate(checked))
