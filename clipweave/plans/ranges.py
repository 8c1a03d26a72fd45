"""Range joins as equi-joins on time blocks of a few levels.

A condition such as ``lo <= t <= hi`` alone gives a nested loop, and the clip key alone puts a long clip in one
task. Both joins here add a key (level, block): blocks of a level are ``RADIX`` times as wide as those of the level
below, and a span is stored at the first level where it touches at most ``COPIES`` + 1 blocks, be it a blink or a
day. The other side probes one block (a point) or a few (a span) of every level, and the exact predicate stays a
residual. A point is thus sent once per level: where all spans are known to be short, as for times widened by a
tolerance, ``length`` says so and there is one level; ``levels_in_use`` finds the levels of a written table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIX = 256
COPIES = 16
LEVELS = (0, 1, 2)  # with 10 s blocks: spans of up to 160 s, 11 hours, and any


def _long(c: Column) -> Column:
    return F.floor(c).cast("long")


def _block(t: Column, width: Column) -> Column:
    """Number of the block holding ``t``, in whole numbers (also before zero)."""
    return F.call_function("div", t - F.pmod(t, width), width)


def _width(level: Column, width: int) -> Column:
    return F.call_function("shiftleft", F.lit(width).cast("long"), level * (RADIX.bit_length() - 1))


def _level(length: Column, width: int) -> Column:
    """Level at which a span of this length is stored."""
    return sum(((length >= F.lit(width * COPIES * RADIX**j)).cast("int") for j in LEVELS[:-1]), F.lit(0))


def _spans(df: DataFrame, lo: Column, hi: Column, width: int) -> DataFrame:
    df = df.withColumn("_lo", _long(lo)).withColumn("_hi", _long(hi)).where(F.col("_lo") <= F.col("_hi"))
    return df.withColumn("_own", _level(F.col("_hi") - F.col("_lo"), width))


def levels_in_use(spans: DataFrame, lo: Column, hi: Column, width: int) -> list[int]:
    """Levels at which ``spans`` are stored: at most as many numbers as there are levels reach the driver."""
    return sorted(r[0] for r in _spans(spans, lo, hi, width).select("_own").distinct().collect()) or [0]


def _stored(spans: DataFrame, levels: Column, width: int) -> DataFrame:
    """One row for each level of ``levels`` and block that a span touches there."""
    at = spans.withColumn("_lv", F.explode(levels))
    w = _width(F.col("_lv"), width)
    return at.withColumn("_b", F.explode(F.sequence(_block(F.col("_lo"), w), _block(F.col("_hi"), w))))


def _apart(df: DataFrame, key: Sequence[str], *more: str) -> DataFrame:
    """``df`` with its key and join columns under names that the other side does not have."""
    return df.select(*[F.col(k).alias(f"_k_{k}") for k in key], *[F.col(c).alias(f"{c}2") for c in more], *[c for c in df.columns if c not in (*key, *more)])


def points_in(
    points: DataFrame,
    spans: DataFrame,
    key: Sequence[str],
    t: Column,
    lo: Column,
    hi: Column,
    width: int,
    how: str = "inner",
    length: int | None = None,
    levels: Sequence[int] = LEVELS,
) -> DataFrame:
    """Join every point to the spans with ``lo <= t <= hi``. ``width`` is the finest block. ``how`` is inner or, where
    no span is longer than ``length``, also left_semi or left_anti seen from the points. Column names of the two
    sides must differ except ``key``."""
    if how != "inner" and length is None:
        raise ValueError(f"{how} needs spans of a known length; use picked")
    return _joined(points, spans, key, t, lo, hi, width, how, length, levels).drop("_t", "_lv", "_b", "_lv2", "_b2", "_lo", "_hi", *[f"_k_{k}" for k in key])


def _joined(points, spans, key, t, lo, hi, width, how, length, levels):
    if length is not None:
        width, levels = max(width, length + 1), (0,)
    stored = _apart(_stored(_spans(spans, lo, hi, width), F.array("_own"), width).drop("_own"), key, "_lv", "_b")
    points = points.withColumn("_t", _long(t)).withColumn("_lv", F.explode(F.array(*map(F.lit, levels))))
    points = points.withColumn("_b", _block(F.col("_t"), _width(F.col("_lv"), width)))
    cond = (F.col("_lv") == F.col("_lv2")) & (F.col("_b") == F.col("_b2")) & F.col("_t").between(F.col("_lo"), F.col("_hi"))
    for k in key:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    return points.join(stored, cond, how)


def picked(
    points: DataFrame,
    spans: DataFrame,
    key: Sequence[str],
    t: Column,
    lo: Column,
    hi: Column,
    width: int,
    picks: Mapping[str, Column],
    length: int | None = None,
    levels: Sequence[int] = LEVELS,
) -> DataFrame:
    """Every point with ``picks``, aggregates over the spans that hold it (of no rows where none does). Equal
    points are joined once and come back each."""
    once = points.groupBy(*points.columns).agg(F.count("*").alias("_copies"))
    j = _joined(once, spans, key, t, lo, hi, width, "left", length, levels)
    out = j.groupBy(*once.columns).agg(*[c.alias(n) for n, c in picks.items()])
    again = F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy")
    return out.select(*points.columns, *picks, again).drop("_copy")


def overlapping(
    a: DataFrame,
    b: DataFrame,
    key: Sequence[str],
    a_span: tuple[Column, Column],
    b_span: tuple[Column, Column],
    width: int,
    levels: Sequence[int] = LEVELS,
    a_levels: Sequence[int] | None = None,
    b_levels: Sequence[int] | None = None,
) -> DataFrame:
    """Pairs of spans that touch or overlap. Each pair is produced once: at the level of the longer of the two, in the
    block where the later of the two begins. ``a_levels`` and ``b_levels`` are the levels in use on a side, where known:
    the other side is then sent to its own level and to the longer ones of these only."""
    a, b = _spans(a, *a_span, width), _spans(b, *b_span, width)

    def reach(others):  # where a partner that is no shorter may be stored
        partner = F.array(*map(F.lit, levels if others is None else others)).cast("array<int>")
        return F.array_union(F.array("_own"), F.filter(partner, lambda x: x > F.col("_own")))

    left, right = _stored(a, reach(b_levels), width), _apart(_stored(b, reach(a_levels), width), key, "_lv", "_b", "_lo", "_hi", "_own")
    cond = (F.col("_lv") == F.col("_lv2")) & (F.col("_b") == F.col("_b2")) & (F.col("_lo") <= F.col("_hi2")) & (F.col("_lo2") <= F.col("_hi"))
    cond = cond & (F.greatest("_own", "_own2") == F.col("_lv")) & (F.col("_b") == _block(F.greatest("_lo", "_lo2"), _width(F.col("_lv"), width)))
    for k in key:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    return left.join(right, cond).drop(*[f"{c}{n}" for c in ("_lv", "_b", "_lo", "_hi", "_own") for n in ("", "2")], *[f"_k_{k}" for k in key])
