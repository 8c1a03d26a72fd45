"""Run merging, contiguity and repair of segment timelines.

Segments are rows ``clip_id, start_us, end_us, left_label, right_label`` in microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import SEC
from ..functions import text as X
from ..plans.folds import ordered_fold
from ..plans.ordered import Blocks, Ordered, by_size

KEY = ["clip_id"]
SEG = ["start_us", "end_us", "left_label", "right_label"]


def fold_case(label: Column | str) -> Column:
    c = F.col(label) if isinstance(label, str) else label
    return F.lower(F.trim(F.coalesce(c, F.lit("N/A"))))


@by_size
def run_length_merge(
    df: DataFrame, labels: list[str], key: list[str] = KEY, blocks: Blocks | None = None
) -> DataFrame:
    """Merge consecutive rows with equal labels (trimmed, case-folded).  The first casing stays and
    time gaps are ignored."""
    o = Ordered(key, ["start_us"], blocks)
    df = o.islands(df.select(*key, "start_us", "end_us", *labels), {c: fold_case(c) for c in labels})
    return (
        df.groupBy(*key, "run")
        .agg(
            F.min("start_us").alias("start_us"),
            F.max_by("end_us", "start_us").alias("end_us"),
            *[F.min_by(c, "start_us").alias(c) for c in labels],
            F.count("*").alias("n_rows"),
        )
    )


@by_size
def derive_track(hands: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """Per-hand intervals of one unchanged label; an idle row ends the interval."""
    o = Ordered(["clip_id", "hand"], ["start_us"], blocks)
    idle = F.upper(F.trim(F.coalesce("label", F.lit("N/A")))).isin("N/A", "NA", "")
    df = hands.select("clip_id", "hand", "start_us", "end_us", "label")
    df = o.islands(df, {"l": F.when(idle, F.lit("")).otherwise(X.normalise_label("label"))})
    return (
        df.where(~idle)
        .groupBy("clip_id", "hand", "run")
        .agg(
            F.min("start_us").alias("start_us"),
            F.max_by("end_us", "start_us").alias("end_us"),
            F.min_by("label", "start_us").alias("object"),
        )
        .drop("run")
    )


@by_size
def direction_runs(points: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """Same-verdict runs over time, with the time each later run switches in."""
    o = Ordered(KEY, ["t_us"], blocks)
    df = o.islands(points.where(F.col("direction").isNotNull()), {"d": F.col("direction")})
    return (
        df.groupBy("clip_id", "run")
        .agg(F.first("direction").alias("direction"), F.count("*").alias("size"), F.min("t_us").alias("start_us"))
        .withColumn("switch_us", F.when(F.col("run") > 1, F.col("start_us")))
    )


@by_size
def recheck_times(runs: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """Times of runs of one where the clip has more than one run."""
    o = Ordered(KEY, ["start_us"], blocks)
    df = o.totals(runs, {"n_runs": ("count", F.lit(1))})
    return df.where((F.col("size") == 1) & (F.col("n_runs") > 1)).select("clip_id", F.col("start_us").alias("t_us"))


def direction_summary(points: DataFrame, runs: DataFrame, clips: DataFrame) -> DataFrame:
    """Counts, majority, run count and rule per clip (all clips listed)."""
    per_run = runs.groupBy("clip_id").agg(
        F.count("*").alias("runs"),
        F.sum(F.when(F.col("direction") == "ASSEMBLY", F.col("size")).otherwise(0)).alias("assembly"),
        F.sum(F.when(F.col("direction") == "DISASSEMBLY", F.col("size")).otherwise(0)).alias("disassembly"),
        F.count_if((F.col("size") >= 2) & (F.col("direction") == "ASSEMBLY")).alias("big_a"),
        F.count_if((F.col("size") >= 2) & (F.col("direction") == "DISASSEMBLY")).alias("big_d"),
    )
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    a, d = n("assembly"), n("disassembly")
    return clips.select("clip_id").join(per_run, KEY, "left").select(
        "clip_id",
        a.alias("assembly"),
        d.alias("disassembly"),
        F.when(a + d == 0, "none").when(a > d, "assembly").when(d > a, "disassembly").otherwise("tie").alias("majority"),
        n("runs").alias("runs"),
        F.when(a + d == 0, "no_decisive_rotation")
        .when((n("big_a") > 0) & (n("big_d") > 0), "mixed_eligible")
        .otherwise("single_direction_majority")
        .alias("rule"),
    )


def stabilise_direction(directions: DataFrame, summary: DataFrame) -> DataFrame:
    """Replace an ambiguous direction by a clear single-direction burst majority of at least two."""
    amb = F.col("direction").isin("other_or_ambiguous", "")
    commit = (
        amb
        & (F.col("rule") == "single_direction_majority")
        & F.col("majority").isin("assembly", "disassembly")
        & (F.col("assembly") + F.col("disassembly") >= 2)
    )
    return directions.join(summary, KEY).select(
        "clip_id", F.when(commit, F.col("majority")).otherwise(F.col("direction")).alias("direction")
    )


def coerce_segments(raw: DataFrame, clips: DataFrame, eps: int = 50_000) -> DataFrame:
    """Cast, clamp to [0, duration], drop what is not longer than ``eps``, default the labels."""
    num = lambda c: F.col(c).try_cast("long")
    clamp = lambda c: F.greatest(F.lit(0).cast("long"), F.least(num(c), F.col("dur_us")))
    lab = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("N/A"))
    good = raw.where(num("start_us").isNotNull() & num("end_us").isNotNull())
    out = good.join(clips.select("clip_id", "dur_us"), KEY).select(
        "clip_id",
        clamp("start_us").alias("start_us"),
        clamp("end_us").alias("end_us"),
        lab("left_label").alias("left_label"),
        lab("right_label").alias("right_label"),
        *([F.col("ord")] if "ord" in raw.columns else []),
    )
    return out.where(F.col("end_us") - F.col("start_us") > eps)


@by_size
def deoverlap(segs: DataFrame, eps: int = 50_000, blocks: Blocks | None = None) -> DataFrame:
    """Push each start up to the previous kept end; drop rows left with ``eps`` or less. Rows that start together
    come in input order where a column ``ord`` gives it, else by their end."""

    def fold(rows):
        prev = None
        for s, e, l, r in rows:
            if prev is not None and s < prev:
                s = prev
            if e - s > eps:
                prev = e
                yield s, e, l, r

    tie = "ord" if "ord" in segs.columns else "end_us"
    reset = None
    if blocks is not None:
        # nothing before can reach this row: every earlier end is at or before its start
        segs = Ordered(KEY, ["start_us", tie], blocks).running(segs, {"_reach": ("max", "end_us")}, exclusive=True)
        reset = F.col("_reach") <= F.col("start_us")
    return ordered_fold(
        segs, KEY, ["start_us", tie], SEG,
        "start_us long, end_us long, left_label string, right_label string", fold, reset, blocks,
    )


@by_size
def bridge_gaps(segs: DataFrame, clips: DataFrame, eps: int = 50_000, blocks: Blocks | None = None) -> DataFrame:
    """Cover [0, duration]: idle rows before, between and after the segments where more than
    ``eps`` is open; clips without segments become one idle row."""
    o = Ordered(KEY, ["start_us"], blocks)
    df = o.neighbours(segs.select("clip_id", *SEG), prev={"_pe": "end_us"}, next={"_nx": F.lit(True)})
    df = df.join(clips.select("clip_id", "dur_us"), KEY)
    row = lambda s, e, l, r: F.struct(s.alias("start_us"), e.alias("end_us"), l.alias("left_label"), r.alias("right_label"))
    na, pe = F.lit("N/A"), F.coalesce("_pe", F.lit(0).cast("long"))
    parts = F.array(
        F.when(F.col("start_us") - pe > eps, row(pe, F.col("start_us"), na, na)),
        row(*[F.col(c) for c in SEG]),
        F.when(F.col("_nx").isNull() & (F.col("dur_us") - F.col("end_us") > eps), row(F.col("end_us"), F.col("dur_us"), na, na)),
    )
    full = df.select("clip_id", F.inline(F.filter(parts, lambda x: x.isNotNull())))
    none = clips.join(segs.select("clip_id").distinct(), KEY, "left_anti")
    return full.unionByName(
        none.select("clip_id", F.lit(0).cast("long").alias("start_us"), F.col("dur_us").alias("end_us"), na.alias("left_label"), na.alias("right_label"))
    )


@by_size
def absorb_slivers(segs: DataFrame, min_us: int = 500_000, blocks: Blocks | None = None) -> DataFrame:
    """A segment shorter than ``min_us`` goes into the previous one, leading ones into the next.

    Every long segment opens a group holding the short ones after it, so no fold is needed.  Leading
    short ones add up: the row at which they reach ``min_us`` together counts as long."""
    o = Ordered(KEY, ["start_us"], blocks)
    df = o.totals(segs, {"_s0": ("min", "start_us")})
    grown = F.col("end_us") - F.col("_s0") >= min_us
    df = o.running(df, {"_seen": ("max", grown.cast("long"))}, exclusive=True)
    long_row = (F.col("end_us") - F.col("start_us") >= min_us) | (grown & (F.coalesce("_seen", F.lit(0)) == 0))
    df = o.running(df, {"_g": ("sum", long_row.cast("long"))})
    best = F.struct(long_row.cast("int").alias("a"), F.col("start_us").alias("b"))
    return (
        df.groupBy("clip_id", F.greatest("_g", F.lit(1)).alias("_g"))
        .agg(
            F.min("start_us").alias("start_us"),
            F.max_by("end_us", "start_us").alias("end_us"),
            F.max_by("left_label", best).alias("left_label"),
            F.max_by("right_label", best).alias("right_label"),
        )
        .drop("_g")
    )


@by_size
def snap_contiguous(segs: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """Start := end of the previous segment."""
    df = Ordered(KEY, ["start_us"], blocks).neighbours(segs, prev={"_pe": "end_us"})
    return df.withColumn("start_us", F.coalesce("_pe", "start_us")).drop("_pe")


@by_size
def clean_timeline(
    raw: DataFrame,
    clips: DataFrame,
    min_us: int = 500_000,
    eps: int = 50_000,
    round_us: int = 100_000,
    blocks: Blocks | None = None,
    cut=lambda df: df,
) -> DataFrame:
    """Strictly valid timeline from raw segments: in bounds, ordered, no overlap, no gap, equal
    neighbours merged, slivers absorbed, times rounded and contiguous.  ``cut`` is called where the
    chain branches; pass `plans.cut.cut` to write the rows there once."""
    df = cut(deoverlap(coerce_segments(raw, clips, eps), eps, blocks))
    df = bridge_gaps(df, clips, eps, blocks)
    merge = lambda d: run_length_merge(d, ["left_label", "right_label"], KEY, blocks).select("clip_id", *SEG)
    df = merge(absorb_slivers(merge(df), min_us, blocks))
    rnd = lambda c: (F.floor((F.col(c) + round_us // 2) / F.lit(round_us)) * round_us).cast("long").alias(c)
    df = df.select("clip_id", rnd("start_us"), rnd("end_us"), "left_label", "right_label")
    return snap_contiguous(df, blocks)


@by_size
def neighbour_context(segs: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """Previous and next labels, with edge markers."""
    o = Ordered(KEY, ["start_us"], blocks)
    df = o.neighbours(
        segs,
        prev={"prev_left": "left_label", "prev_right": "right_label"},
        next={"next_left": "left_label", "next_right": "right_label"},
    )
    for c in ("left", "right"):
        df = df.withColumn(f"prev_{c}", F.coalesce(f"prev_{c}", F.lit("(start)")))
        df = df.withColumn(f"next_{c}", F.coalesce(f"next_{c}", F.lit("(end)")))
    return df


@by_size
def monotone_run(segs: DataFrame, min_run: int = 3, blocks: Blocks | None = None) -> DataFrame:
    """Longest stretch of segments with the same label pair, if at least ``min_run``; earliest on ties."""
    low = lambda c: F.lower(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("n/a")))
    o = Ordered(KEY, ["seg"], blocks and blocks.wide(1_000_000))
    df = o.islands(segs.select("clip_id", "seg", "left_label", "right_label"), {"l": low("left_label"), "r": low("right_label")})
    runs = df.groupBy("clip_id", "run").agg(F.min("seg").alias("seg"), F.count("*").alias("run_len"))
    best = runs.groupBy("clip_id").agg(
        F.max_by(F.struct("seg", "run_len"), F.struct("run_len", -F.col("seg"))).alias("b")
    )
    return best.where(F.col("b.run_len") >= min_run).select("clip_id", "b.seg", "b.run_len")


@by_size
def spans_from_bounds(bounds: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """Consecutive boundaries -> spans."""
    df = Ordered(KEY, ["t_us"], blocks).neighbours(bounds.select("clip_id", "t_us").distinct(), next={"end_us": "t_us"})
    return df.where(F.col("end_us").isNotNull()).select("clip_id", F.col("t_us").alias("start_us"), "end_us")


def boundary_set(segs: DataFrame) -> DataFrame:
    """Distinct starts and ends."""
    return segs.select("clip_id", F.explode(F.array("start_us", "end_us")).alias("t_us")).distinct()


@by_size
def interior(bounds: DataFrame, margin: int = 300_000, blocks: Blocks | None = None) -> DataFrame:
    """Boundaries strictly inside the clip's first and last by more than ``margin``."""
    df = Ordered(KEY, ["t_us"], blocks).totals(bounds, {"_lo": ("min", "t_us"), "_hi": ("max", "t_us")})
    return df.where((F.col("t_us") > F.col("_lo") + margin) & (F.col("t_us") < F.col("_hi") - margin)).drop("_lo", "_hi")


@by_size
def thin(points: DataFrame, gap: int, key: list[str] = KEY, anchor: str | None = None, blocks: Blocks | None = None) -> DataFrame:
    """Greedy minimum spacing: keep a time if it is at least ``gap`` after the last kept one.
    ``anchor`` names a column holding the value that counts as already kept."""

    def fold(rows):
        last = None
        for t, a in rows:
            if last is None:
                last = a
            if last is None or t - last >= gap:
                last = t
                yield (t,)

    cols = points.select(*key, "t_us", (F.col(anchor) if anchor else F.lit(None)).cast("long").alias("_a"))
    reset = None
    if blocks is not None:
        # a row this far after its neighbour is kept whatever was kept before
        cols = Ordered(key, ["t_us"], blocks).neighbours(cols, prev={"_pt": "t_us"})
        reset = F.col("t_us") - F.col("_pt") >= gap
        # the anchor only matters for the first stretch
        cols = cols.withColumn("_a", F.when(F.coalesce(reset, F.lit(False)), None).otherwise(F.col("_a")))
    return ordered_fold(cols, key, ["t_us"], ["t_us", "_a"], "t_us long", fold, reset, blocks)


@by_size
def segments_from_cuts(cuts: DataFrame, clips: DataFrame, margin: int = 200_000, min_us: int = 500_000, blocks: Blocks | None = None) -> DataFrame:
    """Cut times -> contiguous segments of at least ``min_us``; a cut too near the end is dropped."""
    inside = cuts.join(clips, KEY).where((F.col("t_us") > margin) & (F.col("t_us") < F.col("dur_us") - margin))
    inside = inside.select("clip_id", "t_us").distinct().withColumn("_z", F.lit(0).cast("long"))
    kept = thin(inside, min_us, KEY, "_z", blocks)
    kept = kept.join(clips, KEY)
    last = Ordered(KEY, ["t_us"], blocks).neighbours(kept, next={"_n": "t_us"})
    kept = last.where(F.col("_n").isNotNull() | (F.col("dur_us") - F.col("t_us") >= min_us)).select("clip_id", "t_us")
    ends = clips.select("clip_id", F.explode(F.array(F.lit(0).cast("long"), "dur_us")).alias("t_us"))
    return spans_from_bounds(kept.union(ends), blocks)


def guard_rewrite(old: DataFrame, new: DataFrame, clips: DataFrame, long_clip: int = 6 * SEC) -> DataFrame:
    """Keep a clip's rewrite unless it is degenerate: empty, one row on a long clip, or under 60 %
    of an original of five or more rows."""
    n_old = old.groupBy("clip_id").agg(F.count("*").alias("n0"))
    n_new = new.groupBy("clip_id").agg(F.count("*").alias("n1"))
    c = clips.join(n_old, KEY, "left").join(n_new, KEY, "left").na.fill(0, ["n0", "n1"])
    bad = (F.col("n1") < 1) | ((F.col("n1") == 1) & (F.col("dur_us") > long_clip))
    bad = bad | ((F.col("n0") >= 5) & (F.col("n1") * 10 < F.col("n0") * 6))
    ok = c.where(~bad).select("clip_id")
    kept = new.join(ok, KEY, "left_semi").withColumn("source", F.lit("rewrite"))
    return kept.unionByName(old.join(ok, KEY, "left_anti").withColumn("source", F.lit("original")))


def chained_labels(hands: DataFrame) -> DataFrame:
    """Flag labels that narrate more than one action."""
    return hands.where(X.is_chained("label")).select(
        "clip_id", "seg", "hand", F.lit("chained_narrative?").alias("type"), F.col("label").alias("detail")
    )
