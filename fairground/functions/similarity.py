"""Text similarity in [0, 1]."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def seq_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio of the lower-cased texts, 0 when either is empty. Order of arguments matters."""

    def one(a: str | None, b: str | None) -> float:
        return SequenceMatcher(None, a.lower(), b.lower(), autojunk=False).ratio() if a and b else 0.0

    return pd.Series([one(a, b) for a, b in zip(left, right)])


def edit_ratio(left: Column, right: Column) -> Column:
    """1 - levenshtein / longer length of the lower-cased texts, 0 when either is empty. Runs in the JVM."""
    a, b = F.lower(left), F.lower(right)
    longer = F.greatest(F.length(a), F.length(b))
    score = 1 - F.levenshtein(a, b) / longer
    return F.when((F.length(a) > 0) & (F.length(b) > 0), score).otherwise(F.lit(0.0))


def token_overlap(query: Column, text: Column) -> Column:
    """Share of the distinct query words found in the text."""
    words = F.array_distinct(F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != ""))
    found = F.filter(words, lambda w: F.array_contains(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), w))
    return F.when(F.size(words) > 0, F.size(found) / F.size(words)).otherwise(F.lit(0.0))
