"""Runs of segments that read alike: one fold for all merging operators.

Spark takes the labels apart (normal form, different words, idle or not, hands with a label); the fold only
compares what it is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.folds import ordered_fold
from ..plans.ordered import Blocks

KEY = ["clip_id"]
RUN = "start_us long, end_us long, left_label string, right_label string, n long"


class Mark:
    """A label as the fold sees it: its normal form and its words (none for an idle hand)."""

    __slots__ = ("form", "words")

    def __init__(self, form, words):
        self.form, self.words = form, frozenset(words)

    def reads_like(self, form, words, share: float) -> bool:
        if form == self.form:
            return True
        both = sum(w in self.words for w in words)
        return both > 0 and both >= share * (len(self.words) + len(words) - both)


def alike_runs(
    segs: DataFrame,
    share: float,
    fullest: bool = False,
    apart: Column | None = None,
    process: Column | None = None,
    reset: Column | None = None,
    blocks: Blocks | None = None,
) -> DataFrame:
    """Neighbours become one run while both labels share at least ``share`` of their words with the run's labels,
    or the same ``process`` (not NULL) goes on; not where ``apart`` is true. The run's labels are its first row's
    or, with ``fullest``, those of the row that has labels on more hands. ``reset`` marks rows that start a run anyhow."""
    idle = lambda c: X.normalise_label(c) == "n/a"
    none = F.array().cast("array<string>")
    d = segs
    for side in ("left", "right"):
        label = f"{side}_label"
        d = d.withColumn(f"_{side}", X.normalise_label(label)).withColumn(f"_{side}_words", F.when(idle(label), none).otherwise(X.label_token_set(label)))
    d = d.withColumn("_apart", F.coalesce(apart, F.lit(False)) if apart is not None else F.lit(False))
    d = d.withColumn("_full", X.fullness("left_label", "right_label").cast("long"))
    d = d.withColumn("_process", process if process is not None else F.lit(None).cast("string"))

    def fold(rows):
        run = None  # [start, end, left label, right label, rows], then what its rows are compared with
        for start, end, left, right, lc, lw, rc, rw, cut, own, full in rows:
            goes_on = run is not None and not cut
            if goes_on and ((own is not None and own == at_work) or (mark[0].reads_like(lc, lw, share) and mark[1].reads_like(rc, rw, share))):
                run[1], run[4] = end, run[4] + 1
                if not fullest or full <= hands:
                    continue
                run[2:4] = left, right
            else:
                if run is not None:
                    yield tuple(run)
                run, at_work = [start, end, left, right, 1], own
            mark, hands = (Mark(lc, lw), Mark(rc, rw)), full
        if run is not None:
            yield tuple(run)

    cols = ["start_us", "end_us", "left_label", "right_label", "_left", "_left_words", "_right", "_right_words", "_apart", "_process", "_full"]
    return ordered_fold(d, KEY, ["start_us", "end_us"], cols, RUN, fold, reset, blocks)
