"""Scoring against reference timelines."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import SEC
from ..functions import text as X
from ..plans.folds import ordered_fold
from ..plans.ordered import Blocks, Ordered, by_size
from .joins import KEY, WIDTH, label_at


@by_size
def greedy_match(truth: DataFrame, det: DataFrame, tol: int, blocks: Blocks | None = None) -> DataFrame:
    """One-to-one matching: each truth time, in order, takes the first unused detection within ``tol``.

    Truths enter the merged order at t+tol, when every detection they may take has been seen; a queue
    holds the unused ones of the last two tolerances."""

    def fold(rows):
        free: deque = deque()
        for side, t in rows:
            if side == 0:
                free.append(t)
                continue
            while free and free[0] < t - tol:
                free.popleft()
            yield (t, free.popleft() if free else None)

    d = det.select("clip_id", F.col("t_us").alias("pos"), F.lit(0).cast("long").alias("side"), "t_us")
    g = truth.select("clip_id", (F.col("t_us") + tol).alias("pos"), F.lit(1).cast("long").alias("side"), "t_us")
    both = d.union(g)
    reset = None
    if blocks is not None:
        both = Ordered(KEY, ["pos", "side"], blocks).neighbours(both, prev={"_pp": "pos"})
        reset = F.col("pos") - F.col("_pp") > 2 * tol
    return ordered_fold(both, KEY, ["pos", "side"], ["side", "t_us"], "t_us long, det_us long", fold, reset, blocks)


def _scores(counts: DataFrame) -> DataFrame:
    z = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    c = counts.withColumn("recall", z("m", "n_truth")).withColumn("precision", z("m", "n_det"))
    s = F.col("recall") + F.col("precision")
    return c.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("recall") * F.col("precision"), s), F.lit(0.0)))


def _counts(truth: DataFrame, det: DataFrame, tol: int, blocks: Blocks | None) -> DataFrame:
    m = greedy_match(truth, det, tol, blocks).groupBy("clip_id").agg(F.count("det_us").alias("m"), F.count("*").alias("n_truth"))
    d = det.groupBy("clip_id").agg(F.count("*").alias("n_det"))
    return m.join(d, KEY, "full").na.fill(0, ["m", "n_truth", "n_det"])


@by_size
def boundary_scores(truth: DataFrame, det: DataFrame, tol: int = SEC, margin: int = 300_000, blocks: Blocks | None = None) -> DataFrame:
    """Recall, precision and F1 of the boundaries inside the part the truth covers."""
    cover = truth.groupBy("clip_id").agg((F.min("t_us") + margin).alias("_lo"), (F.max("t_us") - margin).alias("_hi"))
    inner = lambda df: df.join(cover, KEY).where((F.col("t_us") > F.col("_lo")) & (F.col("t_us") < F.col("_hi"))).select("clip_id", "t_us")
    c = _counts(inner(truth), inner(det), tol, blocks)
    return _scores(cover.select("clip_id").join(c, KEY, "left").na.fill(0, ["m", "n_truth", "n_det"]))


def macro_mean(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("clips"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.avg("f1").alias("f1"))


@by_size
def score_boundaries(truth: DataFrame, det: DataFrame, tol: int = 800_000, margin: int = 300_000, blocks: Blocks | None = None) -> DataFrame:
    """Recall over all truth boundaries; precision over detections up to the last detection's margin."""
    c = _counts(truth, det, tol, blocks)
    last = det.groupBy("clip_id").agg(F.max("t_us").alias("_last"))
    inner = det.join(last, KEY).where((F.col("t_us") > margin) & (F.col("t_us") < F.col("_last") - margin))
    n = inner.groupBy("clip_id").agg(F.count("*").alias("n_inner"))
    j = c.join(n, KEY, "left").na.fill(0, ["n_inner"])
    z = lambda b: F.coalesce(F.try_divide(F.col("m").cast("double"), F.col(b)), F.lit(0.0))
    return j.select("clip_id", "m", z("n_truth").alias("recall"), z("n_inner").alias("precision"))


@by_size
def determinism(run1: DataFrame, run2: DataFrame, tol: int = 60_000, blocks: Blocks | None = None, strict: bool = False) -> DataFrame:
    """1 where two runs have equally many boundaries, pairwise within ``tol`` (``strict``: closer than it)."""
    o = Ordered(KEY, ["t_us"], blocks)
    a = o.number(run1.select("clip_id", "t_us"), "i")
    b = o.number(run2.select("clip_id", "t_us"), "i").withColumnRenamed("t_us", "u_us")
    j = a.join(b, ["clip_id", "i"], "full")
    off = F.abs(F.col("t_us") - F.col("u_us"))
    ok = F.coalesce(off < tol if strict else off <= tol, F.lit(False))
    return j.groupBy("clip_id").agg(F.min(ok.cast("int")).alias("same"))


def identity_slots(truth: DataFrame, pred: DataFrame, aligned: DataFrame) -> DataFrame:
    """One row per truth hand that names an object, with the aligned predicted label."""
    from .hands import unpivot_hands

    t = unpivot_hands(truth.select("clip_id", "seg", "left_label", "right_label"), value="gt").where(~X.is_na("gt") & (F.col("gt") != ""))
    p = unpivot_hands(pred.select("clip_id", F.col("seg").alias("pred_seg"), "left_label", "right_label"), value="pred")
    j = t.join(aligned.select("clip_id", "seg", "pred_seg"), ["clip_id", "seg"]).join(p, ["clip_id", "pred_seg", "hand"], "left")
    return j.select("clip_id", "seg", "hand", "gt", F.when(X.is_na("pred") | (F.coalesce("pred", F.lit("")) == ""), "N/A").otherwise(F.col("pred")).alias("pred"))


def identity_accuracy(slots: DataFrame) -> DataFrame:
    """Accuracy by clip and overall (NULL clip).  Unjudged slots leave the denominator."""
    m = F.col("match")
    g = slots.rollup("clip_id").agg(
        F.count(m).alias("slots"), F.count_if(m == 1).alias("matched"), F.count_if((m == 0) & (F.col("pred") == "N/A")).alias("na_misses")
    )
    return g.withColumn("acc", F.coalesce(F.try_divide(F.col("matched").cast("double"), F.col("slots")), F.lit(0.0)))


def grounding_precision(index: DataFrame, truth: DataFrame, width: int = WIDTH) -> DataFrame:
    """Grounded rows against the truth at their time: judged, right, and false where the truth is idle.
    Times the truth does not cover are dropped."""
    from .hands import unpivot_hands

    g = index.where(F.col("obj") == 1).select("clip_id", "t_us", "hand", "name")
    at = label_at(g, truth, "slack", width).where(F.col("seg").isNotNull())
    t = unpivot_hands(truth.select("clip_id", "seg", "left_label", "right_label"), value="gt")
    j = at.join(t, ["clip_id", "seg", "hand"])
    idle = X.is_na("gt")
    return j.groupBy("clip_id").agg(
        F.count_if(~idle).alias("judged"),
        F.count_if(~idle & F.contains(F.lower("gt"), F.lower("name"))).alias("right"),
        F.count_if(idle).alias("false_pos"),
    )


def grade_rows(truth: DataFrame, pred: DataFrame, aligned: DataFrame) -> DataFrame:
    """Aligned truth and prediction as one numbered text line per truth segment."""
    p = pred.select("clip_id", F.col("seg").alias("pred_seg"), F.col("left_label").alias("pl"), F.col("right_label").alias("pr"))
    j = truth.join(aligned.select("clip_id", "seg", "pred_seg"), ["clip_id", "seg"]).join(p, ["clip_id", "pred_seg"], "left")
    na = lambda c: F.coalesce(F.col(c), F.lit("N/A"))
    line = F.concat(
        (F.col("seg") + 1).cast("string"), F.lit(". ["), X.seconds_text("start_us"), F.lit("-"), X.seconds_text("end_us"), F.lit("] GT: L="), na("left_label"),
        F.lit(" | R="), na("right_label"), F.lit("  <=>  PRED: L="), na("pl"), F.lit(" | R="), na("pr"),
    )
    return j.select("clip_id", "seg", line.alias("line"))


def tag_overlap(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Tags present on both sides."""
    from .joins import pair_by_tag

    return pair_by_tag(pred, truth).select("tag").distinct()
