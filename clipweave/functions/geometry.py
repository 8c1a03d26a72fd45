"""Hand keypoint geometry.  Keypoints are ``ARRAY<STRUCT<x, y, conf>>`` of 21 points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: keypoint numbers
TIPS = [4, 8, 12, 16, 20]
THUMB_TIP = 4


def _tips(kp: Column, idx, conf: float) -> Column:
    pts = F.array(*[F.get(kp, F.lit(i)) for i in idx])
    return F.filter(pts, lambda p: p["conf"] > conf)


def _mean(pts: Column, c: str) -> Column:
    return F.aggregate(pts, F.lit(0.0), lambda a, p: a + p[c]) / F.size(pts)


def grip_ratio(kp: Column, box: list[Column], conf: float = 0.3) -> Column:
    """Fingertip spread over the box diagonal; NULL with fewer than three confident tips."""
    t = _tips(kp, TIPS, conf)
    span = lambda c: F.array_max(F.transform(t, lambda p: p[c])) - F.array_min(F.transform(t, lambda p: p[c]))
    dx, dy = span("x"), span("y")
    w, h = box[2] - box[0], box[3] - box[1]
    return F.when(F.size(t) >= 3, F.sqrt(dx * dx + dy * dy) / F.greatest(F.lit(1.0), F.sqrt(w * w + h * h)))


def box_centre(box: list[Column]) -> tuple[Column, Column]:
    return (box[0] + box[2]) / 2, (box[1] + box[3]) / 2


def grasp_point(kp: Column, box: list[Column], conf: float = 0.3) -> Column:
    """Centroid of the confident fingertips, the box centre with fewer than two."""
    t = _tips(kp, TIPS, conf)
    cx, cy = box_centre(box)
    ok = F.size(t) >= 2
    return F.struct(F.when(ok, _mean(t, "x")).otherwise(cx).alias("x"), F.when(ok, _mean(t, "y")).otherwise(cy).alias("y"))


def pinch_point(kp: Column, box: list[Column], conf: float = 0.3) -> Column:
    """Midpoint of the thumb tip and the centroid of the other tips, else the grasp point."""
    thumb, others, g = F.get(kp, F.lit(THUMB_TIP)), _tips(kp, TIPS[1:], conf), grasp_point(kp, box, conf)
    ok = F.coalesce(thumb["conf"] > conf, F.lit(False)) & (F.size(others) > 0)
    mid = lambda c: F.when(ok, (thumb[c] + _mean(others, c)) / 2).otherwise(g[c])
    return F.struct(mid("x").alias("x"), mid("y").alias("y"))


def expand_from_wrist(kp: Column, e: float, conf: float = 0.25) -> Column:
    """Confident points moved away from the wrist by the factor 1+e (from their mean without a wrist)."""
    pts = F.transform(kp, lambda p, i: F.struct(i.alias("i"), p["x"].alias("x"), p["y"].alias("y"), p["conf"].alias("conf")))
    ok = F.filter(pts, lambda p: p["conf"] > conf)
    wrist = F.get(kp, F.lit(0))
    has = F.coalesce(wrist["conf"] > conf, F.lit(False))
    ax, ay = F.when(has, wrist["x"]).otherwise(_mean(ok, "x")), F.when(has, wrist["y"]).otherwise(_mean(ok, "y"))
    move = lambda v, a, i: F.bround(F.when(i == 0, v).otherwise(a + (v - a) * (1.0 + e))).cast("long")
    out = F.transform(ok, lambda p: F.struct(move(p["x"], ax, p["i"]).alias("x"), move(p["y"], ay, p["i"]).alias("y")))
    return F.when(F.size(ok) >= 3, out)


def mirror_point(x: Column, y: Column, box: list[Column], w: Column, h: Column) -> tuple[Column, Column]:
    """The point mirrored through the box centre, kept inside the box and the picture."""
    clamp = lambda v, lo, hi: F.greatest(lo, F.least(v, hi))
    return (
        clamp(box[0] + box[2] - x, box[0], F.least(box[2], w - 1)),
        clamp(box[1] + box[3] - y, box[1], F.least(box[3], h - 1)),
    )


def band_fraction(cells: Column, a: list[Column], b: list[Column]) -> Column:
    """Share of cells within max(10, 0.6·length) of the thumb–index segment (``cells``: ARRAY<STRUCT<x, y>>)."""
    vx, vy = b[0] - a[0], b[1] - a[1]
    l2 = vx * vx + vy * vy
    clip = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))

    def inside(c):
        t = F.when(l2 < 1.0, F.lit(0.0)).otherwise(clip(F.try_divide((c["x"] - a[0]) * vx + (c["y"] - a[1]) * vy, l2)))
        dx, dy = c["x"] - (a[0] + t * vx), c["y"] - (a[1] + t * vy)
        return F.sqrt(dx * dx + dy * dy) <= F.greatest(F.lit(10.0), F.sqrt(l2) * 0.6)

    n = F.size(cells)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.filter(cells, inside)).cast("double") / n)
