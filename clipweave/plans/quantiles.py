"""Exact quantiles per key without holding a key's values in one aggregation buffer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Blocks, Ordered, by_size


@by_size
def quantiles(
    df: DataFrame, key: Sequence[str], value: str, qs: dict[str, float], blocks: Blocks | None = None
) -> DataFrame:
    """Linear-interpolated quantiles of the non-NULL values.  With ``blocks`` set (long keys), values
    are counted first and found by running counts; otherwise the built-in percentile is used."""
    df = df.where(F.col(value).isNotNull())
    if blocks is None:
        return df.groupBy(*key).agg(*[F.percentile(value, q).alias(n) for n, q in qs.items()])
    c = df.groupBy(*key, value).agg(F.count("*").alias("_n"))
    o = Ordered(key, [value], Blocks.measure(c, key, value))
    c = o.totals(o.running(c, {"_cum": ("sum", "_n")}), {"_all": ("sum", "_n")})
    out = []
    for n, q in qs.items():
        pos = F.lit(q) * (F.col("_all") - 1)
        lo = F.min(F.when(F.col("_cum") > F.floor(pos), F.col(value))).cast("double")
        hi = F.min(F.when(F.col("_cum") > F.ceil(pos), F.col(value))).cast("double")
        frac = F.max(pos - F.floor(pos))
        out.append((lo * (1 - frac) + hi * frac).alias(n))
    return c.groupBy(*key).agg(*out)
