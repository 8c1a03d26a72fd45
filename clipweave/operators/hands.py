"""Left/right columns to rows and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot_hands(df: DataFrame, left: str = "left_label", right: str = "right_label", value: str = "label") -> DataFrame:
    """One row per hand; the other columns repeat."""
    ids = [c for c in df.columns if c not in (left, right)]
    pair = F.array(
        F.struct(F.lit("left").alias("hand"), F.col(left).alias(value)),
        F.struct(F.lit("right").alias("hand"), F.col(right).alias(value)),
    )
    return df.select(*ids, F.inline(pair))


def pivot_hands(df: DataFrame, ids: list[str], value: str, left: str = "left_label", right: str = "right_label") -> DataFrame:
    """Back to one row per ``ids`` (the first value in sort order, should a hand repeat)."""
    one = lambda hand: F.min(F.when(F.col("hand") == hand, F.col(value)))
    return df.groupBy(*ids).agg(one("left").alias(left), one("right").alias(right))
