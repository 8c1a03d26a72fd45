"""As-of lookups by one merge over the time order; no pairs are formed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Blocks, Ordered, by_size


@by_size
def around(
    left: DataFrame,
    right: DataFrame,
    key: Sequence[str],
    lt: str,
    rt: str,
    cols: dict[str, str],
    ordinal: str | None = None,
    blocks: Blocks | None = None,
) -> DataFrame:
    """Left rows with ``_t``, ``_before`` and ``_after``: structs (``_rt`` and ``cols``, new name ->
    right column) of the last right row at or before and the first at or after the left time.
    Among right rows of one time the lowest ``ordinal`` wins."""
    key = list(key)
    payload = F.struct(F.col(rt).alias("_rt"), *[F.col(c).alias(n) for n, c in cols.items()])
    orow = F.col(ordinal).cast("long") if ordinal else F.lit(0).cast("long")
    rights = right.select(
        *key, F.col(rt).alias("_t"), F.lit(0).alias("_side"), (-orow).alias("_nord"), payload.alias("_r"),
        F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"),
    )
    lefts = left.select(
        *key, F.col(lt).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_nord"),
        F.lit(None).cast(rights.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l"),
    )
    both = lefts.unionByName(rights).withColumn("_back", -F.col("_t"))
    both = Ordered(key, ["_t", "_side", "_nord"], blocks).running(both, {"_before": ("last", "_r")})
    both = Ordered(key, ["_back", "_side", "_nord"], blocks).running(both, {"_after": ("last", "_r")})
    return both.where(F.col("_side") == 1).select("_l.*", "_t", "_before", "_after")


@by_size
def nearest(
    left: DataFrame,
    right: DataFrame,
    key: Sequence[str],
    lt: str,
    rt: str,
    cols: dict[str, str],
    ordinal: str | None = None,
    blocks: Blocks | None = None,
) -> DataFrame:
    """Left rows with the ``cols`` of the right row nearest in time, plus ``distance``.  On a tie the
    earlier right row wins."""
    got = around(left, right, key, lt, rt, cols, ordinal, blocks)
    db, da = F.col("_t") - F.col("_before._rt"), F.col("_after._rt") - F.col("_t")
    pick = F.when(F.col("_after").isNull() | (db <= da), F.col("_before")).otherwise(F.col("_after"))
    got = got.select(*left.columns, "_t", pick.alias("_p"))
    return got.select(
        *left.columns, *[F.col(f"_p.{n}").alias(n) for n in cols], F.abs(F.col("_t") - F.col("_p._rt")).alias("distance")
    )
