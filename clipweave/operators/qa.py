"""Rule-based QA of labels against an independent possession track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import SEC
from ..functions import text as X
from ..plans.ranges import levels_in_use, overlapping
from .joins import WIDTH

HAND_KEY = ["clip_id", "hand"]
ROW = ["clip_id", "seg", "hand", "code", "detail"]


def _segs(hands: DataFrame) -> DataFrame:
    return hands.select("clip_id", "hand", "seg", "start_us", "end_us", "label")


def evidence_levels(track: DataFrame, segs: DataFrame, unit: int = SEC, width: int = WIDTH) -> tuple[list[int], list[int]]:
    """The levels of blocks in use by the segments and by the track, for ``levels`` of the rules below. With
    them each row is sent to the blocks of these only. Reads both, so ``segs`` is best a written table."""
    return levels_in_use(segs, *_widened(unit), width), levels_in_use(track, F.col("start_us"), F.col("end_us"), width)


def _widened(unit: int) -> tuple[Column, Column]:
    return F.col("start_us") - (8 * unit // 10), F.col("end_us") + (8 * unit // 10)


def _evidence(track: DataFrame, hands: DataFrame, unit: int, width: int, levels) -> DataFrame:
    """Every labelled row with what the track says about it: from one overlap join, wide enough for all rules,
    the time covered and first name inside, and around its start and end the first name and whether any agrees."""
    s = _segs(hands).withColumn("_obj", X.object_tokens("label"))
    iv = track.select(
        *HAND_KEY, F.col("start_us").alias("iv_start"), F.col("end_us").alias("iv_end"), "object",
        (~X.is_empty("object", "contact")).alias("_held"), (~X.is_empty("object", "consistency")).alias("_named"),
        X.object_tokens("object").alias("_tokens"),
    ).where(F.col("_held") | F.col("_named"))
    before, after, inset = 8 * unit // 10, unit // 2, unit // 10
    j = overlapping(s, iv, HAND_KEY, _widened(unit), (F.col("iv_start"), F.col("iv_end")), width, a_levels=levels[0], b_levels=levels[1])
    inside = F.col("_held") & (F.col("iv_end") > F.col("start_us") + inset) & (F.col("iv_start") < F.col("end_us") - inset)
    near = lambda edge, tol: F.col("_named") & F.col(edge).between(F.col("iv_start") - tol, F.col("iv_end") + tol)
    order, agree = F.struct("iv_start", "iv_end"), F.arrays_overlap("_tokens", "_obj").cast("int")
    first = lambda cond: F.min_by(F.when(cond, F.col("object")), F.when(cond, order))
    cover = F.least("iv_end", "end_us") - F.greatest("iv_start", "start_us")
    at_start, at_end = near("start_us", before), near("end_us", after)
    found = j.groupBy("clip_id", "hand", "seg").agg(
        F.sum(F.when(inside, cover)).alias("cover_us"), first(inside).alias("inside"),
        F.max(F.when(at_start, agree)).alias("ok_start"), first(at_start).alias("at_start"),
        F.max(F.when(at_end, agree)).alias("ok_end"), first(at_end).alias("at_end"),
    )
    return s.join(found, ["clip_id", "hand", "seg"], "left")


def _contact(unit: int) -> Column:
    """(code, detail) of a row whose label and contact disagree, else NULL."""
    dur, lab = F.col("end_us") - F.col("start_us"), F.upper(F.trim("label"))
    na = (lab == "N/A") & (F.coalesce("cover_us", F.lit(0)) * 10 > dur * 6) & (dur * 10 > unit * 6)
    act = ~lab.isin("N/A", "") & F.col("cover_us").isNull() & (dur > unit)
    return F.when(na, _finding("NA-WHILE-TRACKED", "inside")).when(act, _finding("ACTION-WHILE-UNTRACKED", "label"))


def _mismatch() -> Column:
    """(code, detail) where a releasing hand did not hold the object, or a picking hand does not, else NULL."""
    low = F.lower(F.coalesce("label", F.lit("")))
    named = ~low.isin("", "n/a") & (F.size("_obj") > 0)
    rel, pick = X.has_verb("label", X.RELEASE_VERBS), X.has_verb("label", X.PICK_VERBS)
    return F.when(named & rel & (F.col("ok_start") == 0), _finding("TRACK-MISMATCH", "at_start")).when(
        named & ~rel & pick & (F.col("ok_end") == 0), _finding("TRACK-MISMATCH", "at_end")
    )


def _finding(code: str, detail: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.col(detail).alias("detail"))


def _findings(evidence: DataFrame, *rules: Column) -> DataFrame:
    got = evidence.select("clip_id", "seg", "hand", F.explode(F.array(*rules)).alias("f"))
    return got.where(F.col("f").isNotNull()).select("clip_id", "seg", "hand", "f.code", "f.detail")


def contact_qa(track: DataFrame, hands: DataFrame, unit: int = SEC, width: int = WIDTH, levels=(None, None)) -> DataFrame:
    """Idle label while the track holds something, or an action while it holds nothing."""
    return _findings(_evidence(track, hands, unit, width, levels), _contact(unit))


def track_consistency(track: DataFrame, hands: DataFrame, unit: int = SEC, width: int = WIDTH, levels=(None, None)) -> DataFrame:
    """A releasing hand must have held the object, a picking hand must hold it right after."""
    return _findings(_evidence(track, hands, unit, width, levels), _mismatch())


def pair_exclusivity(segs: DataFrame) -> DataFrame:
    """Both hands given one fine verb on one object."""
    l, r = F.lower(F.coalesce("left_label", F.lit(""))), F.lower(F.coalesce("right_label", F.lit("")))
    lv, rv = X.first_verb("left_label", X.FINE_VERBS), X.first_verb("right_label", X.FINE_VERBS)
    hit = ~l.isin("", "n/a") & ~r.isin("", "n/a") & (lv == rv)
    hit = hit & F.arrays_overlap(X.object_tokens("left_label"), X.object_tokens("right_label"))
    return segs.where(hit).select("clip_id", "seg", F.lit("both").alias("hand"), F.lit("PAIR-MIRROR").alias("code"), lv.alias("detail"))


def direction_counts(hands: DataFrame) -> DataFrame:
    """Labels leaning to assembly and to disassembly per clip."""
    low = F.lower(F.coalesce("label", F.lit("")))
    return hands.groupBy("clip_id").agg(
        F.count_if(X.any_contains(low, X.ASSEMBLY_LABELS)).alias("asm"),
        F.count_if(X.any_contains(low, X.DISASSEMBLY_LABELS)).alias("dis"),
    )


def direction_conflict(hands: DataFrame, directions: DataFrame) -> DataFrame:
    """The decided direction has at least three, and more, labels against it.  Segment -1 = clip level."""
    j = direction_counts(hands).join(directions, "clip_id")
    a, d = F.col("asm"), F.col("dis")
    hit = ((F.col("direction") == "assembly") & (d > a) & (d >= 3)) | ((F.col("direction") == "disassembly") & (a > d) & (a >= 3))
    return j.where(hit).select(
        "clip_id", F.lit(-1).cast("long").alias("seg"), F.lit("both").alias("hand"), F.lit("DIRECTION-CONFLICT").alias("code"), F.col("direction").alias("detail")
    )


def run_qa(track: DataFrame, segs: DataFrame, hands: DataFrame, directions: DataFrame, unit: int = SEC, width: int = WIDTH, levels=(None, None)) -> DataFrame:
    """All findings; ``seg`` counts from 0 and -1 means the whole clip (documents add 1). ``levels`` are those of
    `evidence_levels`, where known."""
    return (
        _findings(_evidence(track, hands, unit, width, levels), _contact(unit), _mismatch())
        .unionByName(pair_exclusivity(segs))
        .unionByName(direction_conflict(hands, directions))
    )
