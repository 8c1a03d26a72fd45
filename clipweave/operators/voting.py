"""Votes, consensus, inventories and probe planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import SEC
from ..functions import text as X
from ..plans.ordered import Blocks, Ordered, by_size
from .hands import unpivot_hands

KEY = ["clip_id"]


def vote_gate(votes: DataFrame, key: list[str]) -> DataFrame:
    """True when either question has a strict majority of the votes (``q1``, ``q2`` are 0/1)."""
    n, a, b = F.count("*"), F.sum("q1"), F.sum("q2")
    return votes.groupBy(*key).agg(((a * 2 > n) | (b * 2 > n)).cast("int").alias("gate"), a.alias("q1"), b.alias("q2"))


@by_size
def consensus(runs: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """Majority over repeated runs, frame by frame (``clip_id, hand, run, t_us, name``).

    Frames are matched by their number in the run; every run that has the frame votes (``n_runs``).  Names vote by
    their core nouns (ties: the earliest run); shown is the winner's most frequent, then longest, raw name."""
    k = ["clip_id", "hand"]
    r = Ordered([*k, "run"], ["t_us"], blocks).number(runs.select(*k, "run", "t_us", "name"), "idx")
    r = r.withColumn("key", X.vote_key("name"))
    f = [*k, "idx"]
    by_name = r.groupBy(*f, "key", "name").agg(F.count("*").alias("n"), F.min("run").alias("first"))
    by_key = by_name.groupBy(*f, "key").agg(
        F.sum("n").alias("n"),
        F.min("first").alias("first"),
        F.max_by("name", F.struct("n", F.length("name"), -F.col("first"))).alias("name"),
    )
    win = by_key.groupBy(*f).agg(F.max_by(F.struct("key", "name"), F.struct("n", -F.col("first"))).alias("w"), F.sum("n").alias("n_runs"))
    return win.select(*f, F.when(F.col("w.key") == "N/A", "empty").otherwise(F.col("w.name")).alias("object"), "n_runs")


STEP = 1000  # frames in which names that are ranked side by side are first seen


def inventory_votes(proposals: DataFrame) -> DataFrame:
    """One vote per frame and lower-cased name; first-seen spelling; ``rank`` by votes, then first seen.
    ``ord`` is the position of the proposal in its frame."""
    p = proposals.where(F.trim("name") != "").withColumn("name", F.trim("name"))
    v = p.groupBy("clip_id", F.lower("name").alias("key")).agg(
        F.count_distinct("frame").alias("votes"),
        F.min(F.struct("frame", "ord")).alias("_f"),
        F.min_by("name", F.struct("frame", "ord")).alias("name"),
    )
    # ranked in steps of equal votes and near first frames: a step's rows rank inside it, after all rows of the steps
    # before it, and only the steps of a clip are lined up
    v = v.withColumn("_b", F.floor(F.col("_f.frame") / STEP))
    step = ["clip_id", "votes", "_b"]
    before = Window.partitionBy("clip_id").orderBy(F.desc("votes"), "_b").rowsBetween(Window.unboundedPreceding, -1)
    steps = v.groupBy(*step).agg(F.count("*").alias("_n"))
    steps = steps.select(*step, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy(*step).orderBy("_f"))
    v = v.withColumn("_in", inside).join(steps, step)
    return v.withColumn("rank", (F.col("_off") + F.col("_in")).cast("int")).drop("_f", "_b", "_in", "_off")


def dominant_name(rows: DataFrame, key: list[str], name: str, order: str) -> DataFrame:
    """Most frequent value per key, the first seen on ties."""
    c = rows.groupBy(*key, name).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return c.groupBy(*key).agg(F.max_by(name, F.struct("_n", -F.col("_first"))).alias(name))


def derive_goal(segs: DataFrame, n: int = 4) -> DataFrame:
    """The ``n`` most used labels (any case) in their first spelling, joined by ``; ``."""
    h = unpivot_hands(segs.select("clip_id", "seg", "left_label", "right_label")).where(~X.is_na("label"))
    h = h.withColumn("label", F.trim("label"))
    c = h.groupBy("clip_id", F.lower("label").alias("low")).agg(
        F.count("*").alias("n"), F.min(F.struct("seg", "hand")).alias("_f"), F.min_by("label", F.struct("seg", "hand")).alias("label")
    )
    r = F.row_number().over(Window.partitionBy("clip_id").orderBy(F.desc("n"), "_f"))
    top = c.withColumn("r", r).where(F.col("r") <= n)
    s = F.sort_array(F.collect_list(F.struct("r", "label")))
    return top.groupBy("clip_id").agg(F.array_join(F.transform(s, lambda x: x["label"]), "; ").alias("goal"))


def ordered_lines(lines: DataFrame, key: list[str], order: str, line: str) -> DataFrame:
    """Distinct lines, at their first position."""
    return lines.groupBy(*key, line).agg(F.min(order).alias(order))


def burst_reduce(bursts: DataFrame) -> DataFrame:
    """Decisive lines of the probes: direction, role and colour fields, each dropped when indeterminate."""
    both = F.concat("verdict", F.lit(" "), F.coalesce("evidence", F.lit("")))
    k = F.col("kind")
    known = k.isin("direction", "role", "colour")
    d = F.when((k == "direction") | ~known, X.direction_class("verdict"))
    role = F.when(k == "role", X.role_class("verdict"))
    col = F.when(k == "role", X.colour_class(both)).when(k == "colour", X.colour_class("verdict"))
    items = F.array(*[F.struct(F.lit(i).alias("part"), x.alias("value")) for i, x in enumerate((d, role, F.concat(F.lit("colour="), col)))])
    rows = bursts.select("clip_id", "t_us", F.inline(items)).where(F.col("value").isNotNull())
    lines = rows.select("clip_id", (F.col("t_us") * 4 + F.col("part")).alias("pos"), X.burst_line("t_us", F.col("value")).alias("line"))
    return ordered_lines(lines, KEY, "pos", "line")


# ---- windows, chunks, probes -----------------------------------------------------------------------
def _parts(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def plan_windows(clips: DataFrame, win: int) -> DataFrame:
    """Even windows of at most ``win`` (a hundredth of a second of slack) over each clip."""
    n = F.greatest(F.lit(1).cast("long"), F.floor((F.col("dur_us") + win - win // 100) / F.lit(win)).cast("long"))
    return _even(clips, n, "win")


def _even(clips: DataFrame, n: Column, name: str) -> DataFrame:
    c = clips.select("clip_id", "dur_us", n.alias("n")).select("*", _parts(F.col("n")).alias(name))
    edge = lambda i: F.expr(f"(dur_us * ({i})) div n")
    return c.select("clip_id", name, edge(name).alias("start_us"), edge(f"{name} + 1").alias("end_us"))


def plan_chunks(clips: DataFrame, max_us: int = 300 * SEC) -> DataFrame:
    """Even parts of at most ``max_us``."""
    n = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("dur_us") / F.lit(max_us)).cast("long"))
    return _even(clips, n, "part")


def plan_probes(clips: DataFrame, spans: DataFrame, every: int = 6 * SEC) -> DataFrame:
    """Direction probes at the middle of even windows (at least four), then a role probe in the first
    span; ``probe`` numbers a clip's requests, so a caller with a budget takes the first ones."""
    n = F.greatest(F.lit(4).cast("long"), F.round(F.col("dur_us") / F.lit(every)).cast("long"))
    w = _even(clips, n, "probe")
    d = w.select("clip_id", "probe", F.expr("(start_us + end_us) div 2").alias("t_us"), F.lit("direction").alias("kind"))
    count = d.groupBy("clip_id").agg(F.count("*").alias("probe"))
    first = spans.groupBy("clip_id").agg(F.min_by(F.struct("start_us", "end_us"), F.struct("start_us", "end_us")).alias("s"))
    role = first.join(count, KEY).select("clip_id", "probe", F.expr("(s.start_us + s.end_us) div 2").alias("t_us"), F.lit("role").alias("kind"))
    return d.union(role)


def token_budget(clips: DataFrame, per_frame: int = 258, fps: float = 1.0, budget: int = 115_000) -> DataFrame:
    """Estimated video tokens, overflow flag, and the frame rate that would fit."""
    sec = F.col("dur_us") / F.lit(1_000_000)
    est = F.lit(per_frame) * F.lit(fps) * sec
    return clips.select(
        "clip_id", F.floor(est).cast("long").alias("tokens"), (est > budget).cast("int").alias("overflow"),
        F.when(est > budget, F.floor(F.try_divide(F.lit(budget * 100.0), F.lit(per_frame) * sec)).cast("long")).alias("fps_x100"),
    )


# ---- sampling --------------------------------------------------------------------------------------
def _numbered(df: DataFrame, order: str, blocks: Blocks | None) -> DataFrame:
    o = Ordered(KEY, [order], blocks)
    return o.totals(o.number(df, "_i"), {"_n": ("count", F.lit(1))})


@by_size
def decimate(df: DataFrame, order: str, cap: int, blocks: Blocks | None = None) -> DataFrame:
    """At most ``cap`` rows per clip, at index floor(j·n/cap)."""
    d = _numbered(df, order, blocks)
    j = F.expr(f"(_i * {cap} + _n - 1) div _n")  # the only j whose index can be _i
    hit = (F.col("_n") <= cap) | ((j < cap) & (F.expr(f"((_i * {cap} + _n - 1) div _n) * _n div {cap}") == F.col("_i")))
    return d.where(hit).drop("_i", "_n")


@by_size
def linspace_pick(df: DataFrame, order: str, k: int, blocks: Blocks | None = None) -> DataFrame:
    """``k`` evenly spaced rows with both ends, index rounded half to even."""
    d = _numbered(df, order, blocks)
    picks = d.select("clip_id", "_n").distinct().where(F.col("_n") > k)
    j = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    picks = picks.select("clip_id", "_n", j.alias("_j")).select("clip_id", F.bround(F.col("_j") * (F.col("_n") - 1) / F.lit(k - 1)).cast("long").alias("_i")).distinct()
    few = d.where(F.col("_n") <= k).drop("_n")
    return few.drop("_i").unionByName(d.drop("_n").join(picks, ["clip_id", "_i"], "left_semi").drop("_i"))


@by_size
def stride_sample(df: DataFrame, order: str, m: int, blocks: Blocks | None = None) -> DataFrame:
    """Every max(1, n // m)-th row, the first ``m`` of them."""
    d = _numbered(df, order, blocks).withColumn("_s", F.greatest(F.lit(1).cast("long"), F.expr(f"_n div {m}")))
    return d.where((F.col("_i") % F.col("_s") == 0) & (F.expr("_i div _s") < m)).drop("_i", "_n", "_s")


@by_size
def every_kth(df: DataFrame, order: str, src_fps: float, target_fps: float, blocks: Blocks | None = None) -> DataFrame:
    """Every k-th row of a clip, k = src / target rounded half to even and at least one."""
    k = max(1, round(src_fps / target_fps))
    return Ordered(KEY, [order], blocks).number(df, "_i").where(F.col("_i") % k == 0).drop("_i")


def assign_shards(df: DataFrame, order: str, n: int, blocks: Blocks | None = None) -> DataFrame:
    """Round-robin shard of each distinct time."""
    o = Ordered(KEY, [order], blocks)
    t = o.number(df.select("clip_id", order).distinct(), "_r").withColumn("shard", F.col("_r") % n).drop("_r")
    return df.join(t, ["clip_id", order])


def time_to_frame(t: Column, fps: float, n: Column) -> Column:
    """Frame index of a time, half to even, clamped to the clip."""
    return F.greatest(F.lit(0).cast("long"), F.least(F.bround(t * F.lit(fps) / F.lit(1_000_000)).cast("long"), n - 1))


def prefer_subset(df: DataFrame, key: list[str], pred: Column) -> DataFrame:
    """Rows satisfying ``pred`` where a key has any, else all its rows."""
    d = df.withColumn("_p", F.coalesce(pred, F.lit(False)).cast("int"))
    any_hit = d.groupBy(*key).agg(F.max("_p").alias("_any"))
    return d.join(any_hit, key).where((F.col("_p") == 1) | (F.col("_any") == 0)).drop("_p", "_any")


def require_inputs(manifest: DataFrame, files: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose files exist, rows skipped)."""
    return manifest.join(files, key, "left_semi"), manifest.join(files, key, "left_anti")


def prompt_counts(prompts: DataFrame) -> DataFrame:
    return prompts.groupBy("clip_id").agg(
        F.count_distinct("t_us").alias("frames"),
        F.count_if(F.col("hand") == "left").alias("left_n"),
        F.count_if(F.col("hand") == "right").alias("right_n"),
    )
