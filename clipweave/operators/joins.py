"""Interval, band, as-of and lookup joins between timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import SEC
from ..functions import text as X
from ..plans.asof import nearest
from ..plans.containment import containment
from ..plans.cut import cut
from ..plans.ordered import Blocks, Ordered, by_size
from ..plans.ranges import LEVELS, levels_in_use, overlapping, picked, points_in

KEY = ["clip_id"]
WIDTH = 10 * SEC


def touching_rows(frames: DataFrame) -> DataFrame:
    """Frames as one row per hand with the touched object."""
    from .hands import unpivot_hands

    return unpivot_hands(frames, "left_touching", "right_touching", "touching")


def frames_in_segments(frames: DataFrame, segs: DataFrame, slack: int = 50_000, width: int = WIDTH) -> DataFrame:
    """Every frame with every segment it falls in (closed, widened by ``slack``)."""
    return points_in(frames, segs, KEY, F.col("t_us"), F.col("start_us") - slack, F.col("end_us") + slack, width)


def _span() -> tuple:
    return F.col("start_us"), F.greatest(F.col("start_us"), F.col("end_us") - 1)


@by_size
def span_frames(frames: DataFrame, spans: DataFrame, width: int = WIDTH, blocks: Blocks | None = None, levels=LEVELS) -> DataFrame:
    """Frames from the first at or after the start through the first at or after the end, inclusive. ``levels`` are
    those of ``span_levels``, where known."""
    f = Ordered(KEY, ["t_us"], blocks).neighbours(frames, prev={"_pt": "t_us"})
    f = f.withColumn("_pt", F.coalesce("_pt", F.lit(-1).cast("long")))
    j = overlapping(f, spans, KEY, (F.col("_pt"), F.col("t_us")), _span(), width, b_levels=levels)
    return j.where((F.col("t_us") >= F.col("start_us")) & (F.col("_pt") < F.col("end_us"))).drop("_pt")


def span_levels(spans: DataFrame, width: int) -> list[int]:
    """Levels of the spans of `span_frames`; ``spans`` is a written table."""
    return levels_in_use(spans, *_span(), width)


def overlap_join(segs: DataFrame, track: DataFrame, key: list[str], margin: int = 100_000, width: int = WIDTH) -> DataFrame:
    """Track intervals reaching more than ``margin`` into a segment, with the covered length.
    Both sides have ``start_us, end_us``; the track's come back as ``iv_start, iv_end``."""
    iv = track.withColumnRenamed("start_us", "iv_start").withColumnRenamed("end_us", "iv_end")
    j = overlapping(segs, iv, key, (F.col("start_us"), F.col("end_us")), (F.col("iv_start"), F.col("iv_end")), width)
    j = j.where((F.col("iv_end") > F.col("start_us") + margin) & (F.col("iv_start") < F.col("end_us") - margin))
    return j.withColumn("cover_us", F.least("iv_end", "end_us") - F.greatest("iv_start", "start_us"))


def near_edge(segs: DataFrame, track: DataFrame, key: list[str], edge: str, tol: int, width: int = WIDTH) -> DataFrame:
    """Track intervals that hold the segment's start or end, widened by ``tol``."""
    iv = track.withColumnRenamed("start_us", "iv_start").withColumnRenamed("end_us", "iv_end")
    return points_in(segs, iv, key, F.col(f"{edge}_us"), F.col("iv_start") - tol, F.col("iv_end") + tol, width)


def _bounds(bounds: DataFrame) -> DataFrame:
    return bounds.select("clip_id", F.col("t_us").alias("b_us"))


def unmatched_events(events: DataFrame, bounds: DataFrame, tol: int = 600_000, width: int = WIDTH) -> DataFrame:
    """Events without any boundary within ``tol``."""
    return points_in(events, _bounds(bounds), KEY, F.col("t_us"), F.col("b_us") - tol, F.col("b_us") + tol, width, "left_anti", 2 * tol)


def owner_segment(events: DataFrame, segs: DataFrame, slack: int = 50_000, width: int = WIDTH) -> DataFrame:
    """First segment holding the event; segment 0 when there is none."""
    s = segs.select("clip_id", "seg", "start_us", "end_us")
    pick = {"seg": F.coalesce(F.min("seg"), F.lit(0))}
    return picked(events, s, KEY, F.col("t_us"), F.col("start_us") - slack, F.col("end_us") + slack, width, pick)


def edge_segment(events: DataFrame, segs: DataFrame, side: str, tol: int = 400_000, width: int = WIDTH) -> DataFrame:
    """Last segment whose end (``before``) or start (``after``) is within ``tol`` of the event."""
    edge = F.col("end_us" if side == "before" else "start_us")
    s = segs.select("clip_id", "seg", edge.alias("edge_us"))
    return picked(events, s, KEY, F.col("t_us"), F.col("edge_us") - tol, F.col("edge_us") + tol, width, {"seg": F.max("seg")}, 2 * tol)


def protected(bounds: DataFrame, events: DataFrame, tol: int = 500_000, width: int = WIDTH) -> DataFrame:
    """Boundary rows with a flag: an event lies within ``tol``."""
    ev = events.select("clip_id", F.col("t_us").alias("e_us")).distinct()
    hit = points_in(bounds, ev, KEY, F.col("t_us"), F.col("e_us") - tol, F.col("e_us") + tol, width, "left_semi", 2 * tol)
    hit = hit.select(*bounds.columns).withColumn("_hit", F.lit(1))
    return bounds.join(hit.select("clip_id", "t_us", "_hit").distinct(), ["clip_id", "t_us"], "left").select(
        *bounds.columns, F.coalesce("_hit", F.lit(0)).alias("protected")
    )


@by_size
def contain_or_nearest(
    points: DataFrame, spans: DataFrame, slack: int, width: int = WIDTH, blocks: Blocks | None = None
) -> DataFrame:
    """Number of the first span holding the point (widened by ``slack``), else of the span with the
    nearest midpoint.  ``points`` has ``clip_id, p_id, t_us``; ``spans`` has ``clip_id, seg, start_us, end_us``.
    Midpoints are compared at half-microsecond precision."""
    s = spans.select("clip_id", "seg", "start_us", "end_us")
    inside = picked(points, s, KEY, F.col("t_us"), F.col("start_us") - slack, F.col("end_us") + slack, width, {"seg": F.min("seg")})
    rest = inside.where(F.col("seg").isNull()).drop("seg").withColumn("_t2", F.col("t_us") * 2)
    mids = s.withColumn("_m2", F.col("start_us") + F.col("end_us"))
    wide = blocks.scaled(2) if blocks else None
    near = nearest(rest, mids, KEY, "_t2", "_m2", {"seg": "seg"}, "seg", wide).drop("_t2", "distance")
    found = inside.where(F.col("seg").isNotNull()).withColumn("how", F.lit("contains"))
    return found.unionByName(near.withColumn("how", F.lit("nearest")))


@by_size
def align_by_midpoint(truth: DataFrame, pred: DataFrame, slack: int = 10_000, width: int = WIDTH, blocks: Blocks | None = None) -> DataFrame:
    """For each truth span the predicted span covering its midpoint, else the nearest one."""
    pts = truth.select("clip_id", F.col("seg").alias("p_id"), F.floor((F.col("start_us") + F.col("end_us")) / 2).alias("t_us"))
    got = contain_or_nearest(pts, pred, slack, width, blocks)
    return got.select("clip_id", F.col("p_id").alias("seg"), F.col("seg").alias("pred_seg"), "how")


@by_size
def nearest_frame(events: DataFrame, frames: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """Nearest frame number for each event time (earlier frame on ties)."""
    return nearest(events, frames, KEY, "t_us", "t_us", {"frame": "frame"}, None, blocks)


@by_size
def nearest_within(events: DataFrame, frames: DataFrame, tol: int, blocks: Blocks | None = None) -> DataFrame:
    """Nearest frame if no further than ``tol``, else NULL."""
    n = nearest_frame(events, frames, blocks)
    return n.withColumn("frame", F.when(F.col("distance") <= tol, F.col("frame"))).drop("distance")


def label_at(points: DataFrame, segs: DataFrame, mode: str, width: int = WIDTH) -> DataFrame:
    """First segment at a time under one of three edge rules: ``slack`` (closed, 0.05 s wider),
    ``closed`` (exact) or ``half_open`` (end excluded but for 1 ms)."""
    s = segs.select("clip_id", "seg", "start_us", "end_us")
    lo, hi = {
        "slack": (F.col("start_us") - 50_000, F.col("end_us") + 50_000),
        "closed": (F.col("start_us"), F.col("end_us")),
        "half_open": (F.col("start_us"), F.col("end_us") + 999),
    }[mode]
    return picked(points, s, KEY, F.col("t_us"), lo, hi, width, {"seg": F.min("seg")})


def contact_pairs(entities: DataFrame) -> DataFrame:
    """Each hand entity with the entity it says it is in contact with (NULL when absent)."""
    other = entities.select("frame", F.col("entity").alias("in_contact"), F.col("name").alias("object"))
    hands = entities.where(F.col("in_contact").isNotNull())
    return hands.join(other, ["frame", "in_contact"], "left")


def overlay_labels(base: DataFrame, over: DataFrame, key: list[str]) -> DataFrame:
    """Take the overlay's name where present; ``fallback`` marks rows that keep the base."""
    o = over.select(*key, F.col("name").alias("_over"))
    return base.join(o, key, "left").select(
        *key, F.coalesce("_over", "label").alias("label"), F.col("_over").isNull().cast("int").alias("fallback")
    )


def needs_review(segs: DataFrame, flags: DataFrame, qa: DataFrame) -> DataFrame:
    """Mark segments that carry a flag or a QA finding."""
    hit = flags.select("clip_id", "seg").union(qa.select("clip_id", "seg")).distinct().withColumn("_hit", F.lit(1))
    return segs.join(hit, ["clip_id", "seg"], "left").withColumn("needs_review", F.coalesce("_hit", F.lit(0))).drop("_hit")


def pair_by_tag(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Pair each prediction tag with the first (by name) truth file whose name contains it."""
    pairs = containment(pred.select(F.col("tag").alias("needle")), truth.select(F.col("name").alias("hay")))
    return pairs.groupBy(F.col("needle").alias("tag")).agg(F.min("hay").alias("name"))


def apply_overrides(segs: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace whole clips by their override rows."""
    rest = segs.join(overrides.select("clip_id").distinct(), KEY, "left_anti").withColumn("override_applied", F.lit(0))
    return rest.unionByName(overrides.withColumn("override_applied", F.lit(1)))


def override_originals(segs: DataFrame, overrides: DataFrame) -> DataFrame:
    """The rows that `apply_overrides` sets aside: the pipeline's own segments of overridden clips."""
    return segs.join(overrides.select("clip_id").distinct(), KEY, "left_semi")


def oov_words(hands: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Label words missing from the clip's catalogue (longer than two, not a number)."""
    w = hands.select("clip_id", F.explode(X.label_words("label")).alias("word")).distinct()
    w = w.where((F.length("word") > 2) & ~F.col("word").rlike("^[0-9]+$"))
    cat = catalogue.select("clip_id", F.explode(F.concat(X.label_words("name"), X.label_words("colour"))).alias("word"))
    return w.join(cat.distinct(), ["clip_id", "word"], "left_anti")


def snap_vocab(pred: DataFrame, vocab: DataFrame) -> DataFrame:
    """Snap a free name to the clip's vocabulary: exact (any case), keep a composite that contains
    a known name, else the first known name containing it, else N/A.  Vocabulary order is ``ord``."""
    low = cut(pred.select("clip_id", F.lower("name").alias("_low")).where(F.col("_low").isNotNull()).distinct())
    known = cut(vocab.select("clip_id", "ord", "name", F.lower("name").alias("known")))
    exact = known.groupBy("clip_id", F.col("known").alias("_low")).agg(F.max_by("name", F.struct("ord", "name")).alias("_exact"))
    # names that contain a known name, and the first known name that contains them
    inner = containment(known.withColumnRenamed("known", "needle"), low.withColumnRenamed("_low", "hay"), KEY)
    inner = inner.select("clip_id", F.col("hay").alias("_low"), F.lit(True).alias("_inner")).distinct()
    outer = containment(low.withColumnRenamed("_low", "needle"), known.withColumnRenamed("known", "hay"), KEY)
    outer = outer.join(known.withColumnRenamed("known", "hay"), ["clip_id", "hay"]).groupBy("clip_id", F.col("needle").alias("_low"))
    outer = outer.agg(F.min_by("name", F.struct("ord", "name")).alias("_outer"))
    some = known.groupBy("clip_id").agg(F.lit(True).alias("_some"), F.max(F.col("known") == "").alias("_blank"))
    found = low.join(exact, ["clip_id", "_low"], "left").join(inner, ["clip_id", "_low"], "left").join(outer, ["clip_id", "_low"], "left")
    j = pred.withColumn("_low", F.lower("name")).join(found, ["clip_id", "_low"], "left").join(some, KEY, "left")
    bad = F.upper(F.coalesce("name", F.lit(""))).isin("N/A", "NA", "")
    snapped = (
        F.when(bad, "N/A")
        .when(F.col("_some").isNull(), F.col("name"))
        .when(F.col("_exact").isNotNull(), F.col("_exact"))
        .when(F.coalesce("_inner", "_blank"), F.col("name"))
        .otherwise(F.coalesce("_outer", F.lit("N/A")))
    )
    return j.select(*pred.columns, snapped.alias("snapped"))


def other_hand(prompts: DataFrame) -> DataFrame:
    """Attach the other hand's anchor at the same time."""
    o = prompts.select("clip_id", "t_us", F.when(F.col("hand") == "left", "right").otherwise("left").alias("hand"),
                       F.col("x").alias("other_x"), F.col("y").alias("other_y"))
    return prompts.join(o, ["clip_id", "t_us", "hand"], "left")


def segment_identity(prompts: DataFrame, index: DataFrame) -> DataFrame:
    """Name per segment and hand from primary prompts and index rows; a row without object gives NULL.
    ``seg_id`` is the segment's number followed by the hand letter."""
    num, hand = lambda c: F.expr(f"left({c}, length({c}) - 1)"), lambda c: F.right(F.col(c), F.lit(1))
    segs = prompts.where(F.col("primary") == 1).groupBy("clip_id", num("seg_id").alias("num")).agg(F.min("seg_start").alias("seg_start"))
    ix = index.select("clip_id", num("seg_id").alias("num"), hand("seg_id").alias("_h"), "t_us",
                      F.when(F.col("obj") == 1, F.col("name")).alias("name"))
    last = lambda h: F.max_by(F.when(F.col("_h") == h, F.struct("name")), F.when(F.col("_h") == h, F.col("t_us")))
    ix = ix.groupBy("clip_id", "num").agg(last("L").alias("_l"), last("R").alias("_r"))
    return segs.join(ix, ["clip_id", "num"], "left").select(
        "clip_id", "num", "seg_start", F.col("_l.name").alias("left_name"), F.col("_r.name").alias("right_name")
    )
