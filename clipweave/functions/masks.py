"""Bit masks as ``ARRAY<BIGINT>`` (64 cells a word) and box arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum_bits(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.bit_count(w))


def area(m: Column) -> Column:
    return _sum_bits(m)


def overlap(a: Column, b: Column) -> Column:
    return _sum_bits(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))


def union_area(a: Column, b: Column) -> Column:
    return _sum_bits(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))


def union(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def iou(a: Column, b: Column) -> Column:
    """0 for two empty masks, NULL when either is missing."""
    u = union_area(a, b)
    return F.when(u == 0, F.lit(0.0)).otherwise(overlap(a, b).cast("double") / u)


def inside_fraction(a: Column, b: Column) -> Column:
    """Share of ``a`` lying in ``b``."""
    n = area(a)
    return F.when(n == 0, F.lit(0.0)).otherwise(overlap(a, b).cast("double") / n)


def meets(a: Column, b: Column) -> Column:
    return F.exists(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)), lambda w: w != 0)


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Boxes as [x0, y0, x1, y1]."""
    w = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = (w * h).cast("double")
    size = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    u = size(a) + size(b) - inter
    return F.when(u <= 0, F.lit(0.0)).otherwise(inter / u)
