"""Possession tracks, transition events, and edits of segment boundaries."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import SEC
from ..functions import text as X
from ..plans.asof import around
from ..plans.folds import ordered_fold
from ..plans.ordered import Blocks, Ordered, by_size
from ..plans.ranges import points_in
from .joins import KEY, WIDTH, protected
from .possession import Possession, frame_columns
from .runs import alike_runs
from .timeline import thin

HAND_KEY = ["clip_id", "hand"]
SEG_OUT = "start_us long, end_us long, left_label string, right_label string"


# ---- possession track ------------------------------------------------------------------------------
@by_size
def build_track(
    contact: DataFrame, min_us: int = 250_000, empty_split: int = 3, gap: int = 300_000, blocks: Blocks | None = None
) -> DataFrame:
    """Per-frame contact (``clip_id, hand, t_us, object``) to possession intervals.

    An interval ends after ``empty_split`` empty frames in a row or when the name no longer matches
    the interval's first name (a shared word of more than three letters counts as a match).  Short
    intervals are dropped, the most frequent name is kept, and small gaps snap to their midpoint."""
    says = frame_columns()
    contact = contact.select("*", *[c.alias(f"_{n}") for n, c in says.items()])

    def fold(rows):
        hand = Possession(min_us, empty_split)
        for frame in rows:
            done = hand.feed(*frame)
            if done:
                yield done
        done = hand.close()
        if done:
            yield done

    reset = None
    if blocks is not None:
        # after this many empty frames nothing is open any more
        contact = contact.withColumn("_e", F.col("_empty").cast("long"))
        contact = Ordered(HAND_KEY, ["t_us"], blocks).rolling(contact, "_w", "_e", empty_split, 0)
        n = F.aggregate(F.slice("_w", 1, empty_split), F.lit(0).cast("long"), lambda a, r: a + r["v"])
        reset = (F.col("_e") == 0) & (F.size("_w") == empty_split + 1) & (n == empty_split)
    cols = ["t_us", "_shown", "_same", "_ties", "_empty"]
    t = ordered_fold(contact, HAND_KEY, ["t_us", "_shown"], cols, "start_us long, end_us long, object string", fold, reset, blocks)
    return snap_gaps(t, gap, blocks)


@by_size
def snap_gaps(track: DataFrame, gap: int = 300_000, blocks: Blocks | None = None) -> DataFrame:
    """Close gaps of at most ``gap`` at their midpoint."""
    t = Ordered(HAND_KEY, ["start_us"], blocks).neighbours(track, prev={"_pe": "end_us"}, next={"_ns": "start_us"})
    small = lambda a, b: (b - a > 0) & (b - a <= gap)
    mid = lambda a, b: F.floor((a + b) / 2).cast("long")
    s, e, pe, ns = F.col("start_us"), F.col("end_us"), F.col("_pe"), F.col("_ns")
    return t.select(
        *HAND_KEY,
        F.when(small(pe, s), mid(pe, s)).otherwise(s).alias("start_us"),
        F.when(small(e, ns), mid(e, ns)).otherwise(e).alias("end_us"),
        "object",
    )


@by_size
def track_cuts(track: DataFrame, events: DataFrame, clips: DataFrame, long_gap: int = SEC, merge_gap: int = 600_000, margin: int = 200_000, blocks: Blocks | None = None) -> DataFrame:
    """Cut times: hand events, long gaps in a hand's track, and changes of the held object."""
    t = Ordered(HAND_KEY, ["start_us"], blocks).neighbours(track, next={"_ns": "start_us", "_no": "object"})
    toks = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.col(c)), " "), lambda w: F.length(w) > 3)))
    hit = (F.col("_ns") - F.col("end_us") >= long_gap) | (toks("object") != toks("_no"))
    gaps = t.where(F.col("_ns").isNotNull() & hit).select("clip_id", F.floor((F.col("end_us") + F.col("_ns")) / 2).cast("long").alias("t_us"))
    ev = events.where(F.col("kind").isin("place", "pickup", "handoff")).select("clip_id", "t_us")
    c = ev.union(gaps).join(clips, KEY).where((F.col("t_us") > margin) & (F.col("t_us") < F.col("dur_us") - margin))
    return thin(c.select("clip_id", "t_us").distinct(), merge_gap, blocks=blocks)


def clip_intervals(track: DataFrame, a: Column, b: Column, eps: int = 50_000) -> DataFrame:
    """Intervals cut to the window [a, b]; what is not longer than ``eps`` is dropped."""
    t = track.withColumn("start_us", F.greatest("start_us", a)).withColumn("end_us", F.least("end_us", b))
    return t.where(F.col("end_us") > F.col("start_us") + eps)


def slice_time(df: DataFrame, a: int, b: int, slack: int = 50_000, t: str = "t_us") -> DataFrame:
    """Rows in [a, b] widened by ``slack`` (a plain range predicate, so it reaches the scan)."""
    return df.where(F.col(t).between(F.lit(a - slack), F.lit(b + slack)))


def shift_time(df: DataFrame, off: Column, cols: list[str]) -> DataFrame:
    """Add an offset to time columns; values that are not numbers stay as they are."""
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("long", "integer", "double")}
    return df.select(*[(F.col(c) + off).alias(c) if c in cols and c in numeric else F.col(c) for c in df.columns])


# ---- transition events -------------------------------------------------------------------------------
def locked_transitions(events: DataFrame, clips: DataFrame, margin: int = 300_000) -> DataFrame:
    """Distinct event times strictly inside the clip."""
    j = events.join(clips, KEY).where((F.col("t_us") > margin) & (F.col("t_us") < F.col("dur_us") - margin))
    return j.select("clip_id", "t_us").distinct()


def required_cuts(events: DataFrame, clips: DataFrame, margin: int = 300_000) -> DataFrame:
    """One hint per event: «KIND-HAND» at its time."""
    j = events.join(clips, KEY).where((F.col("t_us") > margin) & (F.col("t_us") < F.col("dur_us") - margin))
    hand = F.lower(F.coalesce("hand", F.lit("")))
    tag = F.when(hand.isin("left", "right"), F.concat(F.lit("«"), F.upper("kind"), F.lit("-"), F.upper(hand), F.lit("»"))).otherwise(
        F.concat(F.lit("«"), F.upper("kind"), F.lit("»"))
    )
    return j.select("clip_id", "t_us", F.concat(tag, F.lit(" at "), X.seconds_text("t_us"), F.lit("s")).alias("hint"))


@by_size
def add_missing_events(events: DataFrame, gaps: DataFrame, clips: DataFrame, tol: int = 600_000, margin: int = 500_000, width: int = WIDTH, blocks: Blocks | None = None) -> DataFrame:
    """Add reported gaps as events, in input order (``ord``), unless one already lies within ``tol``."""
    g = gaps.join(clips, KEY).where((F.col("t_us") > margin) & (F.col("t_us") < F.col("dur_us") - margin)).drop("dur_us")
    have = events.select("clip_id", F.col("t_us").alias("h_us"))
    g = points_in(g, have, KEY, F.col("t_us"), F.col("h_us") - tol, F.col("h_us") + tol, width, "left_anti", 2 * tol)
    o = Ordered(KEY, ["t_us", "ord"], blocks)
    g = o.neighbours(g, prev={"_pt": "t_us"})
    g = o.running(g, {"_near": ("sum", (F.col("_pt").isNull() | (F.col("t_us") - F.col("_pt") > tol)).cast("long"))})

    def fold(rows):
        kept: list[int] = []
        for row in rows:
            if all(abs(row[0] - k) > tol for k in kept):
                kept.append(row[0])
                yield row

    new = ordered_fold(g, [*KEY, "_near"], ["ord"], ["t_us", "hand", "kind", "object"], "t_us long, hand string, kind string, object string", fold)
    return new.select("clip_id", "t_us", "hand", X.gap_kind("kind").alias("kind"), "object")


# ---- boundary edits ------------------------------------------------------------------------------------
@by_size
def enforce_cuts(segs: DataFrame, cuts: DataFrame, margin: int = 250_000, width: int = WIDTH, blocks: Blocks | None = None) -> DataFrame:
    """Split segments at cut times lying more than ``margin`` inside; both parts keep the label."""
    k = ["clip_id", "seg"]
    s = segs.select(*k, F.col("start_us").alias("s_us"), F.col("end_us").alias("e_us"))
    inside = points_in(cuts.select("clip_id", "t_us").distinct(), s, KEY, F.col("t_us"), F.col("s_us") + margin + 1, F.col("e_us") - margin - 1, width)
    kept = thin(inside.select(*k, "t_us", "s_us"), margin + 1, k, "s_us", blocks)
    return _split_at(segs, kept, blocks)


def _split_at(segs: DataFrame, cuts: DataFrame, blocks: Blocks | None) -> DataFrame:
    """Segments cut at ``cuts`` (clip_id, seg, t_us); ``piece`` numbers the parts of a segment."""
    k = ["clip_id", "seg"]
    pts = cuts.select(*k, "t_us").union(segs.select(*k, F.explode(F.array("start_us", "end_us")).alias("t_us"))).distinct()
    o = Ordered(k, ["t_us"], blocks)
    p = o.neighbours(pts, next={"_e": "t_us"}).where(F.col("_e").isNotNull())
    p = o.number(p, "piece")
    keep = [c for c in segs.columns if c not in (*k, "start_us", "end_us")]
    return p.join(segs.select(*k, *keep), k).select(*k, "piece", F.col("t_us").alias("start_us"), F.col("_e").alias("end_us"), *keep)


@by_size
def split_unlabelled(segs: DataFrame, cuts: DataFrame, eps: int = 50_000, width: int = WIDTH, blocks: Blocks | None = None) -> DataFrame:
    """Split at cuts inside a segment: the first part keeps the labels, the others have none."""
    k = ["clip_id", "seg"]
    s = segs.select(*k, F.col("start_us").alias("s_us"), F.col("end_us").alias("e_us"))
    inside = points_in(cuts.select("clip_id", "t_us").distinct(), s, KEY, F.col("t_us"), F.col("s_us") + 1, F.col("e_us") - 1, width)
    p = _split_at(segs, inside.select(*k, "t_us"), blocks)
    lab = lambda c: F.when(F.col("piece") == 0, F.col(c)).alias(c)
    return p.where(F.col("end_us") - F.col("start_us") >= eps).select(*k, "piece", "start_us", "end_us", lab("left_label"), lab("right_label"))


def _delete_boundaries(segs: DataFrame, asks: DataFrame, tol: int, seam: bool, edges: DataFrame | None, width: int, blocks: Blocks | None) -> DataFrame:
    """Walk each clip from its end, merging at every request the first remaining boundary nearer than
    ``tol``.  Requests are ``clip_id, t_us, keep``; only boundaries close to one are ever touched."""
    if edges is not None:
        # first possession edge after each segment start (by more than 0.15 s in the data's scale)
        got = around(segs, edges, KEY, "_from", "t_us", {"edge": "t_us"}, None, blocks)
        segs = got.select(*segs.columns, F.col("_after.edge").alias("edge"))
    else:
        segs = segs.withColumn("edge", F.lit(None).cast("long")).withColumn("_pad", F.lit(0).cast("long"))

    def fold(rows):
        held: deque = deque()  # blocks from late to early; [start, end, left, right, edge, n, pad, hands with a label]
        for pos, kind, s, e, l, r, edge, pad, keep, hands in rows:
            if kind == 1:
                held.append([s, e, l, r, edge, 1, pad, hands])
            elif len(held) > 1 and abs(held[-1][1] - s) < tol:
                a, b = held[-1], held[-2]
                if seam and a[4] is not None and a[4] < b[1] - a[6]:
                    continue  # possession changes inside
                src = (a if a[7] >= b[7] else b) if seam else (b if keep == "after" else a)
                held.pop()
                held[-1] = [a[0], b[1], src[2], src[3], a[4], a[5] + b[5], a[6], src[7]]
            while len(held) > 1 and held[1][1] >= pos + 2 * tol:
                yield out(held.popleft())
        while held:
            yield out(held.popleft())

    def out(b):
        return b[0], b[1], b[2], b[3], b[5]

    num = lambda c: (F.col(c) if isinstance(c, str) else c).cast("long")
    nul = lambda t: F.lit(None).cast(t)
    rows = segs.select(
        "clip_id", (-num("end_us")).alias("back"), F.lit(1).alias("kind"), num("start_us").alias("s"), num("end_us").alias("e"), "left_label", "right_label", "edge", num("_pad").alias("pad"), nul("string").alias("keep"), num(X.fullness("left_label", "right_label")).alias("hands")
    )
    reqs = asks.select(
        "clip_id", (-(num("t_us") - tol)).alias("back"), F.lit(0).alias("kind"), num("t_us").alias("s"), nul("long").alias("e"), nul("string").alias("left_label"), nul("string").alias("right_label"), nul("long").alias("edge"), nul("long").alias("pad"), F.col("keep"), nul("long").alias("hands")
    )
    both = rows.unionByName(reqs).withColumn("pos", -F.col("back"))
    reset = None
    if blocks is not None:
        near = points_in(
            segs.select("clip_id", "end_us").distinct(), asks.select("clip_id", F.col("t_us").alias("a_us")).distinct(), KEY,
            F.col("end_us"), F.col("a_us") - tol, F.col("a_us") + tol, width, "left_semi", 2 * tol,
        ).select("clip_id", F.col("end_us").alias("e"), F.lit(1).alias("_near"))
        both = both.join(near, ["clip_id", "e"], "left")
        reset = (F.col("kind") == 1) & F.col("_near").isNull()
    cols = ["pos", "kind", "s", "e", "left_label", "right_label", "edge", "pad", "keep", "hands"]
    return ordered_fold(both, KEY, ["back", "kind"], cols, SEG_OUT + ", n long", fold, reset, blocks)


@by_size
def apply_merges(segs: DataFrame, merges: DataFrame, events: DataFrame, tol: int = 400_000, guard: int = 500_000, width: int = WIDTH, blocks: Blocks | None = None) -> DataFrame:
    """Delete boundaries a critic named (``t_us``, ``keep`` = before/after), except near an event."""
    return _delete_boundaries(segs, _unguarded(merges, events, guard, width), tol, False, None, width, blocks)


def _unguarded(asks: DataFrame, events: DataFrame, guard: int, width: int) -> DataFrame:
    ev = events.select("clip_id", F.col("t_us").alias("e_us"))
    return points_in(asks, ev, KEY, F.col("t_us"), F.col("e_us") - guard, F.col("e_us") + guard, width, "left_anti", 2 * guard)


@by_size
def apply_seam_merges(segs: DataFrame, asks: DataFrame, events: DataFrame, track: DataFrame, tol: int = 250_000, guard: int = 500_000, pad: int = 150_000, width: int = WIDTH, blocks: Blocks | None = None) -> DataFrame:
    """Merge across window seams unless an event is near or possession changes inside; the fuller
    label stays (the left one on ties)."""
    edges = track.select("clip_id", F.explode(F.array("start_us", "end_us")).alias("t_us")).distinct()
    s = segs.withColumn("_from", F.col("start_us") + pad + 1).withColumn("_pad", F.lit(pad).cast("long"))
    a = _unguarded(asks, events, guard, width).withColumn("keep", F.lit(None).cast("string"))
    return _delete_boundaries(s, a, tol, True, edges, width, blocks)


def apply_corrections(segs: DataFrame, fixes: DataFrame) -> DataFrame:
    """Label corrections by segment and hand; the last one (``ord``) wins."""
    f = fixes.where(F.col("hand").isin("left", "right")).groupBy("clip_id", "seg").agg(
        *[F.max_by("label", F.when(F.col("hand") == h, F.col("ord"))).alias(f"_{h}") for h in ("left", "right")],
        *[F.max(F.when(F.col("hand") == h, F.col("ord"))).alias(f"_o{h}") for h in ("left", "right")],
    )
    j = segs.join(f, ["clip_id", "seg"], "left")
    for h in ("left", "right"):
        lab = F.coalesce(F.nullif(F.col(f"_{h}"), F.lit("")), F.col(f"{h}_label"))
        j = j.withColumn(f"{h}_from", F.when(F.col(f"_o{h}").isNotNull(), F.col(f"{h}_label")))
        j = j.withColumn(f"{h}_label", F.when(F.col(f"_o{h}").isNotNull(), lab).otherwise(F.col(f"{h}_label")))
    return j.drop("_left", "_right", "_oleft", "_oright")


@by_size
def fuzzy_merge(segs: DataFrame, thr: float = 0.6, guard: str | None = None, blocks: Blocks | None = None) -> DataFrame:
    """Merge neighbours whose labels read alike on both hands, compared with the run's first labels,
    which stay.  ``guard`` names a 0/1 column: 1 means the boundary before the row must stay."""

    reset = None
    apart = (F.col(guard) == 1) if guard else None
    if blocks is not None:
        # an idle hand only matches an idle hand, so a change of pattern always breaks
        pat = F.concat((X.normalise_label("left_label") == "n/a").cast("string"), (X.normalise_label("right_label") == "n/a").cast("string"))
        segs = Ordered(KEY, ["start_us"], blocks).neighbours(segs.withColumn("_pat", pat), prev={"_pp": "_pat"})
        reset = (F.coalesce(apart, F.lit(False)) if guard else F.lit(False)) | (F.col("_pat") != F.col("_pp"))
    return alike_runs(segs, thr, apart=apart, reset=reset, blocks=blocks)


def guarded_boundaries(segs: DataFrame, events: DataFrame, tol: int = 500_000, width: int = WIDTH) -> DataFrame:
    """Segments with ``guard``: an event lies within ``tol`` of the boundary before them."""
    p = protected(segs.withColumn("t_us", F.col("start_us")), events, tol, width)
    return p.withColumnRenamed("protected", "guard").drop("t_us")


def keep_best(attempts: DataFrame) -> DataFrame:
    """Attempt to keep: a good verdict first, then most segments, then the earliest."""
    rank = F.struct((F.col("verdict") != "good").cast("int").alias("a"), (-F.col("n_segments")).alias("b"), F.col("attempt").alias("c"))
    return attempts.groupBy("clip_id").agg(F.min_by("attempt", rank).alias("attempt"))


def failing_stage(before: Column, after: Column) -> Column:
    """A flipped direction needs new cuts, anything else new labels."""
    return F.when(~before.eqNullSafe(after), "segment").otherwise("label")
