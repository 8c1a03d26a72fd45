"""Deterministic timeline analysis: frequencies, cross-checks and structural flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import SEC
from ..functions import text as X
from ..plans.ordered import Blocks, Ordered, by_size
from ..plans.quantiles import quantiles
from .hands import unpivot_hands
from .joins import KEY, WIDTH, edge_segment, frames_in_segments, oov_words, owner_segment, protected, touching_rows, unmatched_events
from .timeline import monotone_run


def seq_blocks(blocks: Blocks | None) -> Blocks | None:
    """Block width for keys numbered 0, 1, 2, … instead of timed."""
    return blocks and blocks.wide(1_000_000)


def word_freq(segs: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` most used label words per clip over both hands; ties by first occurrence."""
    h = unpivot_hands(segs.select("clip_id", "seg", "left_label", "right_label"))
    w = h.select("clip_id", "seg", "hand", F.posexplode(X.label_words("label")).alias("pos", "word"))
    c = w.groupBy("clip_id", "word").agg(F.count("*").alias("n"), F.min(F.struct("seg", "hand", "pos")).alias("_first"))
    r = F.row_number().over(Window.partitionBy("clip_id").orderBy(F.desc("n"), "_first"))
    return c.withColumn("rank", r).where(F.col("rank") <= n).drop("_first")


def kind_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("clip_id").agg(
        F.count_if(F.col("kind") == "pickup").alias("pickups"), F.count_if(F.col("kind") == "place").alias("places")
    )


def contact_stats(frames: DataFrame, segs: DataFrame, slack: int = 50_000, width: int = WIDTH) -> DataFrame:
    """Per segment and hand: frames, empty frames, and the distinct words touched."""
    s = segs.select("clip_id", "seg", "start_us", "end_us")
    j = touching_rows(frames_in_segments(frames.select("clip_id", "t_us", "left_touching", "right_touching"), s, slack, width))
    g = ["clip_id", "seg", "hand"]
    empty = X.is_empty("touching", "analysis")
    names = F.collect_set(F.when(~empty, F.col("touching")))  # the different names a hand touches in one segment
    n = j.groupBy(*g).agg(F.count("*").alias("n"), F.count_if(empty).alias("n_empty"), names.alias("_names"))
    base = unpivot_hands(s.withColumn("l", F.lit(0)).withColumn("r", F.lit(0)), "l", "r", "_x").select(*g)
    none = F.array().cast("array<string>")
    return base.join(n, g, "left").select(
        *g,
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("n_empty", F.lit(0)).alias("n_empty"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(F.coalesce("_names", none), X.label_words)))).alias("touched"),
    )


def empty_fraction(stats: DataFrame) -> DataFrame:
    """Share of empty frames; 1.0 where a segment has none."""
    frac = F.coalesce(F.try_divide(F.col("n_empty").cast("double"), F.col("n")), F.lit(1.0))
    return stats.select("clip_id", "seg", "hand", frac.alias("empty_fraction"))


def contact_crosscheck(segs: DataFrame, stats: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Labels against raw contact: active but empty, object never touched, idle but holding."""
    h = unpivot_hands(segs.select("clip_id", "seg", "left_label", "right_label")).join(stats, ["clip_id", "seg", "hand"])
    words = F.array_distinct(X.label_words("label"))
    if catalogue is not None:
        cat = catalogue.select("clip_id", F.explode(F.concat(X.label_words("name"), X.label_words("colour"))).alias("w"))
        h = h.join(cat.distinct().groupBy("clip_id").agg(F.collect_list("w").alias("_cat")), KEY, "left")
        words = F.when(F.size(F.coalesce("_cat", F.array())) > 0, F.array_intersect(words, "_cat")).otherwise(words)
    idle = F.lower(F.trim("label")).isin("n/a", "")
    mostly_empty = F.col("n_empty") * 10 >= F.col("n") * 8  # holds for no frames too
    unsupported = (F.size("touched") > 0) & (F.size(words) > 0) & ~F.arrays_overlap(words, F.col("touched"))
    holding = (F.col("n") > 0) & (F.col("n_empty") * 10 <= F.col("n") * 3) & (F.size("touched") > 0)
    kind = (
        F.when(~idle & mostly_empty, "contact_says_idle?")
        .when(~idle & unsupported, "object_unsupported?")
        .when(idle & holding, "idle_but_holding?")
    )
    return h.select("clip_id", "seg", "hand", kind.alias("type")).where(F.col("type").isNotNull())


@by_size
def duration_outliers(segs: DataFrame, floor_us: int = 8 * SEC, blocks: Blocks | None = None) -> DataFrame:
    """Segments at least ``floor_us`` long and six times the clip's median, in clips of three or more."""
    d = segs.select("clip_id", "seg", (F.col("end_us") - F.col("start_us")).alias("dur_us"))
    med = quantiles(d, KEY, "dur_us", {"med": 0.5}, blocks).join(d.groupBy("clip_id").agg(F.count("*").alias("n")), KEY)
    j = d.join(med.where(F.col("n") >= 3), KEY)
    hit = (F.col("med") > 0) & (F.col("dur_us") >= F.greatest(F.lit(float(floor_us)), 6 * F.col("med")))
    return j.where(hit).select("clip_id", "seg", "dur_us", (F.col("med") * 2).cast("long").alias("median_x2"))


def missed_boundaries(segs: DataFrame, events: DataFrame, tol: int = 600_000, width: int = WIDTH) -> DataFrame:
    """Events without an inner boundary nearby, attached to the segment that holds them."""
    n = segs.groupBy("clip_id").agg(F.max("seg").alias("_last"))
    s = segs.select("clip_id", "seg", "start_us", "end_us").join(n, KEY)
    inner = s.select(
        "clip_id",
        F.explode(
            F.filter(
                F.array(F.when(F.col("seg") > 0, F.col("start_us")), F.when(F.col("seg") < F.col("_last"), F.col("end_us"))),
                lambda x: x.isNotNull(),
            )
        ).alias("t_us"),
    ).distinct()
    ev = events.select("clip_id", "t_us", "kind", "hand")
    return owner_segment(unmatched_events(ev, inner, tol, width), segs, 50_000, width)


def static_hands(frames: DataFrame, clips: DataFrame, min_dur: int = 8 * SEC) -> DataFrame:
    """Hands that touch at most one word and are almost never empty over a whole clip."""
    r = touching_rows(frames.select("clip_id", "left_touching", "right_touching")).withColumn("_e", X.is_empty("touching", "analysis"))
    n = r.groupBy("clip_id", "hand").agg(F.count("*").alias("n"), F.count_if("_e").alias("ne"))
    w = r.where(~F.col("_e")).select("clip_id", "hand", F.explode(X.label_words("touching")).alias("w"))
    w = w.groupBy("clip_id", "hand").agg(F.count_distinct("w").alias("nw"))
    j = n.join(w, ["clip_id", "hand"], "left").join(clips, KEY)
    hit = (F.coalesce("nw", F.lit(0)) <= 1) & (F.col("ne") * 100 <= F.col("n") * 2) & (F.col("dur_us") > min_dur)
    return j.where(hit).select("clip_id", "hand", F.coalesce("nw", F.lit(0)).alias("n_words"), "n", F.col("ne").alias("n_empty"))


def frozen_across(segs: DataFrame, events: DataFrame, tol: int = 400_000, width: int = WIDTH) -> DataFrame:
    """The acting hand keeps one label on both sides of its own event."""
    ev = events.where(F.lower("hand").isin("left", "right")).select("clip_id", "t_us", F.lower("hand").alias("hand"), "kind")
    b = edge_segment(ev, segs, "before", tol, width).withColumnRenamed("seg", "seg_b")
    a = edge_segment(ev, segs, "after", tol, width).withColumnRenamed("seg", "seg_a")
    j = b.join(a, ["clip_id", "t_us", "hand", "kind"]).where(F.col("seg_b") != F.col("seg_a"))
    h = unpivot_hands(segs.select("clip_id", "seg", "left_label", "right_label"))
    low = F.lower(F.trim(F.coalesce("label", F.lit("n/a"))))
    lab = lambda s, n: h.select("clip_id", F.col("seg").alias(s), "hand", low.alias(n))
    j = j.join(lab("seg_b", "lb"), ["clip_id", "seg_b", "hand"]).join(lab("seg_a", "la"), ["clip_id", "seg_a", "hand"])
    j = j.where((F.col("lb") == F.col("la")) & ~F.col("lb").isin("n/a", ""))
    return j.select("clip_id", F.col("seg_a").alias("seg"), "hand", "kind", "t_us", F.col("la").alias("label"))


@by_size
def dup_across(segs: DataFrame, events: DataFrame, tol: int = 400_000, width: int = WIDTH, blocks: Blocks | None = None) -> DataFrame:
    """Neighbours with the same label pair and an event on their boundary."""
    low = lambda c: F.lower(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("n/a")))
    s = segs.select("clip_id", "seg", "start_us", F.col("end_us").alias("t_us"), low("left_label").alias("l"), low("right_label").alias("r"))
    s = Ordered(KEY, ["start_us"], blocks).neighbours(s, next={"nl": "l", "nr": "r"})
    s = s.where((F.col("l") == F.col("nl")) & (F.col("r") == F.col("nr"))).select("clip_id", "t_us", "seg")
    return protected(s, events, tol, width).where(F.col("protected") == 1).select("clip_id", (F.col("seg") + 1).alias("seg"))


@by_size
def timeline_analysis(segs: DataFrame, events: DataFrame, unit: int = SEC, width: int = WIDTH, blocks: Blocks | None = None) -> DataFrame:
    """All structural flags: monotone run, duration outlier, missed boundary, frozen and duplicate
    labels across an event.  ``unit`` is the length of one second in the data's time scale."""
    t = lambda df, name: df.select("clip_id", "seg", F.lit(name).alias("type"))
    return (
        t(monotone_run(segs, 3, blocks), "monotone_run?")
        .union(t(duration_outliers(segs, 8 * unit, blocks), "duration_outlier?"))
        .union(t(missed_boundaries(segs, events, 6 * unit // 10, width), "missed_boundary?"))
        .union(t(frozen_across(segs, events, 4 * unit // 10, width), "frozen_across_transition?"))
        .union(t(dup_across(segs, events, 4 * unit // 10, width, blocks), "dup_across_transition?"))
    )


def force_rerun(verdicts: DataFrame, flags: DataFrame) -> DataFrame:
    """A structural flag turns a good verdict into a rerun."""
    hit = flags.where(F.col("type").isin("frozen_across_transition?", "dup_across_transition?")).select("clip_id").distinct()
    j = verdicts.join(hit.withColumn("_s", F.lit(1)), KEY, "left")
    forced = (F.col("verdict") == "good") & F.col("_s").isNotNull()
    return j.select("clip_id", F.when(forced, "needs_rerun").otherwise(F.col("verdict")).alias("verdict"))


def timeline_text(segs: DataFrame, page: int = 1000) -> DataFrame:
    """Numbered text rows, joined in order in pages of ``page`` segments (one string never has to
    hold an unbounded clip)."""
    row = F.concat(
        F.lit("#"), (F.col("seg") + 1).cast("string"), F.lit("  ["), X.seconds_text("start_us"), F.lit("-"),
        X.seconds_text("end_us"), F.lit("s] L: "), F.col("left_label"), F.lit(" R: "), F.col("right_label"),
    )
    return text_pages(segs.select("clip_id", "seg", row.alias("line")), page)


def text_pages(lines: DataFrame, page: int = 1000, sep: str = "\n") -> DataFrame:
    """Ordered concatenation of ``line`` by ``seg`` within pages of bounded length."""
    g = lines.withColumn("page", F.floor(F.col("seg") / page)).groupBy("clip_id", "page")
    ordered = F.sort_array(F.collect_list(F.struct("seg", "line")))
    return g.agg(F.array_join(F.transform(ordered, lambda x: x["line"]), sep).alias("text"))


@by_size
def sequence_review(segs: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """Advisory: adjacent duplicates, runs of four or more on a hand, a deposit with nothing acquired.

    Both hands have a label in every segment, so they stay beside one another: all three findings come from windows over
    one order of the segments, which are sorted once."""
    o = Ordered(KEY, ["start_us"], blocks)
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit("n/a"))))
    s = segs.select("clip_id", "seg", "start_us", low("left_label").alias("left"), low("right_label").alias("right"))
    hands = ("left", "right")
    no = F.lit(False)
    d = o.neighbours(s, prev={f"_p{h}": h for h in hands})
    d = d.select(*s.columns, *[F.coalesce(F.col(f"_p{h}") == F.col(h), no).alias(f"_{h}0") for h in hands])  # goes on as before
    for i in (1, 2, 3):  # and so do the segments after it
        d = o.neighbours(d, next={f"_{h}{i}": f"_{h}{i - 1}" for h in hands})
    acq, dep = (lambda h: X.has_verb(h, X.PICK_VERBS)), (lambda h: X.has_verb(h, X.RELEASE_VERBS))
    d = o.running(d, {f"_{n}{h}": ("sum", f(h).cast("long")) for h in hands for n, f in (("a", acq), ("d", dep))}, exclusive=True)
    found = lambda cond, hand, kind: F.when(cond, F.struct(F.lit(hand).alias("hand"), F.lit(kind).alias("type")))
    items = [found(F.col("_left0") & F.col("_right0"), "both", "adjacent_duplicate?")]
    for h in hands:
        goes_on = [F.coalesce(f"_{h}{i}", no) for i in (1, 2, 3)]
        items.append(found(~F.col(f"_{h}0") & goes_on[0] & goes_on[1] & goes_on[2], h, "long_run?"))
        items.append(found(dep(h) & (F.coalesce(f"_a{h}", F.lit(0)) <= F.coalesce(f"_d{h}", F.lit(0))), h, "deposit_without_acquire?"))
    return d.select("clip_id", "seg", F.inline(F.filter(F.array(*items), lambda x: x.isNotNull())))


@by_size
def pick_place_balance(events: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """Places without an earlier open pick of the object, and picks never placed."""
    key = ["clip_id", "object"]
    e = events.where(F.col("kind").isin("pickup", "place")).select(*key, "t_us", "kind").withColumn("_back", -F.col("t_us"))
    out = None
    for opener, closer, order, label in (("pickup", "place", "t_us", "place_without_pick"), ("place", "pickup", "_back", "pick_without_place")):
        o = Ordered(key, [order], blocks)
        step = F.when(F.col("kind") == opener, 1).otherwise(-1).cast("long")
        d = o.running(e, {"_bal": ("sum", step)})
        d = o.running(d, {"_low": ("min", "_bal")}, exclusive=True)
        bad = (F.col("kind") == closer) & (F.col("_bal") < F.least(F.lit(0), F.coalesce("_low", F.lit(0))))
        d = d.where(bad).select(*key, "t_us", F.lit(label).alias("finding"))
        out = d if out is None else out.unionByName(d)
    return out


def flags_from_review(review: DataFrame, segs: DataFrame, mode: str) -> DataFrame:
    """Reviewer rows (1-based ``seg``) to flags (0-based).  Out of range: ``drop`` or ``first``."""
    n = segs.groupBy("clip_id").agg(F.count("*").alias("_n"))
    j = review.join(n, KEY, "left").withColumn("_s", F.col("seg").try_cast("long") - 1)
    ok = F.coalesce(F.col("_s").between(F.lit(0), F.col("_n") - 1), F.lit(False))
    if mode == "drop":
        j = j.where(ok)
    return j.select(
        "clip_id", F.when(ok, F.col("_s")).otherwise(0).cast("long").alias("seg"), "type", "detail"
    )


# fixed values: directions the reviewer may set
DIRECTIONS = ["assembly", "disassembly", "transfer_or_portioning", "mixed_or_alternating", "other_or_ambiguous"]


def apply_direction(state: DataFrame, review: DataFrame) -> DataFrame:
    """Accept a reviewed direction from the known set; a flip forces a rerun; the goal changes only
    when the review says it corrected it."""
    j = state.join(review, KEY, "left")
    flip = F.coalesce(F.col("new_direction").isin(DIRECTIONS) & (F.col("new_direction") != F.col("direction")), F.lit(False))
    goal = (F.coalesce("purpose_check", F.lit("")) != "") & (F.col("purpose_verdict") == "corrected")
    return j.select(
        "clip_id",
        F.when(flip, F.col("new_direction")).otherwise(F.col("direction")).alias("direction"),
        F.when(flip, "needs_rerun").otherwise(F.col("quality_verdict")).alias("verdict"),
        F.when(F.coalesce(goal, F.lit(False)), F.col("purpose_check")).otherwise(F.col("goal")).alias("goal"),
    )


def live_flags(flags: DataFrame, segs: DataFrame) -> DataFrame:
    """Flags whose segment still exists, 1-based."""
    n = segs.groupBy("clip_id").agg(F.max("seg").alias("_last"))
    j = flags.join(n, KEY).where(F.col("seg").between(F.lit(0), F.col("_last")))
    return j.withColumn("seg", F.col("seg") + 1).drop("_last")


def flags_by_segment(flags: DataFrame) -> DataFrame:
    """Flag types of each segment in order, one row per segment."""
    s = F.sort_array(F.collect_list(F.struct("ord", "type")))
    return flags.groupBy("clip_id", "seg").agg(F.array_join(F.transform(s, lambda x: x["type"]), ", ").alias("types"), F.count("*").alias("n"))


def report_lines(segs: DataFrame, events: DataFrame) -> DataFrame:
    """Advisory report: one line per kind of count and clip."""
    wf = word_freq(segs)
    item = F.concat("word", F.lit("×"), F.col("n").cast("string"))
    words = wf.groupBy("clip_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", item.alias("i")))), lambda x: x["i"]), ", ").alias("_w"))
    kc = kind_counts(events)
    return (
        words.select("clip_id", F.lit(1).alias("line_no"), F.concat(F.lit("label word frequency (most used): "), "_w").alias("line"))
        .union(kc.select("clip_id", F.lit(3), F.concat(F.lit("detected transitions: "), F.col("pickups").cast("string"), F.lit(" pickup, "), F.col("places").cast("string"), F.lit(" place"))))
    )


# fixed values: how the report introduces words that no known object has
OOV_INTRO = "label words NOT in the 1A catalogue (may include verbs — judge which are objects; an object here is a likely rename/hallucination): "


def catalogue_lines(segs: DataFrame, objects: DataFrame) -> DataFrame:
    """The report's second part, for clips with a catalogue (``clip_id, ord, name, colour``): its names in order, and the
    label words that it lacks. Both have ``line_no`` 2 and sort by their text."""
    named = objects.where(F.coalesce("name", F.lit("")) != "")
    order = F.sort_array(F.collect_list(F.struct("ord", "name")))
    names = named.groupBy("clip_id").agg(F.array_join(F.transform(order, lambda x: x["name"]), ", ").alias("_names"))
    hands = unpivot_hands(segs.select("clip_id", "seg", "left_label", "right_label"))
    words = oov_words(hands.join(names.select("clip_id"), KEY, "left_semi"), objects)
    lacking = words.groupBy("clip_id").agg(F.array_join(F.array_sort(F.collect_set("word")), ", ").alias("_words"))
    return names.select("clip_id", F.lit(2).alias("line_no"), F.concat(F.lit("catalogue (1A) objects: "), "_names").alias("line")).union(
        lacking.select("clip_id", F.lit(2), F.concat(F.lit(OOV_INTRO), "_words"))
    )
