"""Long clips annotated in parts: offsets, stitching, and repair of the seams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.asof import around
from ..plans.ordered import Blocks, Ordered, by_size
from ..plans.ranges import picked
from .joins import KEY


@by_size
def part_offsets(parts: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """Segments and frames in the parts before this one (``part``, ``n_segs``, ``n_frames``)."""
    o = Ordered(KEY, ["part"], blocks and blocks.wide(100_000))
    p = o.running(parts, {"seg_off": ("sum", "n_segs"), "frame_off": ("sum", "n_frames")}, exclusive=True)
    return p.na.fill(0, ["seg_off", "frame_off"])


@by_size
def merge_parts(segs: DataFrame, parts: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """Part-local segments to one timeline: times moved by the part's offset, numbers by the running
    count.  ``segs`` has ``part, seg, start_us, end_us``; ``parts`` has ``part, off_us``."""
    n = segs.groupBy("clip_id", "part").agg(F.count("*").alias("n_segs"))
    p = parts.join(n, ["clip_id", "part"], "left").na.fill(0, ["n_segs"]).withColumn("n_frames", F.lit(0))
    p = part_offsets(p, blocks).select("clip_id", "part", "off_us", "seg_off")
    j = segs.join(p, ["clip_id", "part"])
    return j.select(
        "clip_id",
        (F.col("seg") + F.col("seg_off")).alias("seg"),
        (F.col("start_us") + F.col("off_us")).alias("start_us"),
        (F.col("end_us") + F.col("off_us")).alias("end_us"),
        *[c for c in segs.columns if c not in ("clip_id", "part", "seg", "start_us", "end_us")],
    )


# times and segment numbers of the tables of a part; other columns stay as they are
MOVES = {
    "segments": (("start_us", "end_us"), ("seg",)),
    "lanes": (("start_us", "end_us"), ()),
    "track": (("start_us", "end_us"), ()),
    "contact": (("t_us",), ()),
    "transitions": (("t_us", "start_us", "end_us"), ()),
    "phases": (("t_us",), ()),
    "flags": ((), ("seg",)),
    "qa": ((), ("seg",)),
}


def merge_part_tables(tables: dict[str, DataFrame], parts: DataFrame, blocks: Blocks | None = None) -> dict[str, DataFrame]:
    """All tables of separately annotated parts on one timeline: each time moved by its part's offset, each segment
    number by the segments before its part (a finding on the whole part, seg -1, keeps its number).

    ``tables`` are named as in ``MOVES`` and have ``clip_id, part``; ``parts`` has ``clip_id, part, off_us``. The offsets
    are one small table, numbered once; every table meets it in one join and keeps all its other columns."""
    n = tables["segments"].groupBy("clip_id", "part").agg(F.count("*").alias("n_segs"))
    p = parts.join(n, ["clip_id", "part"], "left").na.fill(0, ["n_segs"]).withColumn("n_frames", F.lit(0))
    p = part_offsets(p, blocks).select("clip_id", "part", F.col("off_us").alias("_off"), F.col("seg_off").alias("_segs"))
    out = {}
    for name, df in tables.items():
        times, segs = MOVES[name]
        j = df.join(p, ["clip_id", "part"])
        moved = {c: F.col(c) + F.col("_off") for c in times if c in df.columns}
        moved |= {c: F.when(F.col(c) >= 0, F.col(c) + F.col("_segs")).otherwise(F.col(c)) for c in segs}
        out[name] = j.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in df.columns if c != "part"])
    return out


def merge_direction(parts: DataFrame) -> DataFrame:
    """One distinct direction over the parts, else ``mixed_or_alternating``."""
    d = F.nullif(F.col("direction"), F.lit(""))
    return parts.groupBy("clip_id").agg(
        F.when(F.min(d).eqNullSafe(F.max(d)), F.min(d)).otherwise("mixed_or_alternating").alias("direction")
    )


def merge_goal(parts: DataFrame) -> DataFrame:
    """Distinct goals in order of first use, joined by `` | ``."""
    g = parts.where(F.coalesce("goal", F.lit("")) != "").groupBy("clip_id", "goal").agg(F.min("part").alias("part"))
    s = F.sort_array(F.collect_list(F.struct("part", "goal")))
    return g.groupBy("clip_id").agg(F.array_join(F.transform(s, lambda x: x["goal"]), " | ").alias("goal"))


def merge_objects(objects: DataFrame) -> DataFrame:
    """Union of the parts' objects by lower-cased name; the first one stays."""
    o = objects.where(F.coalesce("name", F.lit("")) != "")
    return o.groupBy("clip_id", F.lower("name").alias("key")).agg(F.min_by("name", F.struct("part", "ord")).alias("name"))


@by_size
def seam_jobs(segs: DataFrame, seams: DataFrame, tol: int = 250_000, min_us: int = 500_000, blocks: Blocks | None = None) -> DataFrame:
    """Span to annotate again at each seam: from the last segment before it through the first one
    after it.  Jobs sharing a segment (a part of one segment) become one job."""
    p = seams.select("clip_id", "t_us", (F.col("t_us") + tol).alias("_hi"), (F.col("t_us") - tol).alias("_lo"))
    s = segs.select("clip_id", "seg", "start_us", "end_us")
    left = around(p, s, KEY, "_hi", "end_us", {"seg": "seg", "at": "start_us"}, "seg", blocks)
    left = left.select("clip_id", "t_us", "_lo", F.col("_before.seg").alias("li"), F.col("_before.at").alias("a_us"))
    both = around(left, s, KEY, "_lo", "start_us", {"seg": "seg", "at": "end_us"}, "seg", blocks)
    j = both.select("clip_id", "t_us", "li", "a_us", F.col("_after.seg").alias("ri"), F.col("_after.at").alias("b_us"))
    j = j.where((F.col("ri") > F.col("li")) & (F.col("b_us") - F.col("a_us") >= min_us))
    o = Ordered(KEY, ["li", "t_us"], blocks and blocks.wide(1_000_000))
    j = o.running(j, {"_far": ("max", "ri")}, exclusive=True)
    j = o.running(j, {"job": ("sum", (F.col("_far").isNull() | (F.col("li") > F.col("_far"))).cast("long"))})
    return j.groupBy("clip_id", "job").agg(
        F.min("li").alias("li"), F.max("ri").alias("ri"), F.min("a_us").alias("a_us"), F.max("b_us").alias("b_us"), F.count("*").alias("n_seams")
    )


@by_size
def splice_seams(segs: DataFrame, jobs: DataFrame, new: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """Replace each job's segments by its new rows (``clip_id, job, start_us, …``, times local to the
    job) and number the timeline again.  Jobs without new rows leave their segments alone."""
    done = jobs.join(new.select("clip_id", "job").distinct(), ["clip_id", "job"], "left_semi")
    rest = picked(segs, done.select("clip_id", "li", "ri"), KEY, F.col("seg"), F.col("li"), F.col("ri"), 64, {"_jobs": F.count("li")})
    rest = rest.where(F.col("_jobs") == 0)
    cols = [c for c in segs.columns if c != "seg"]
    add = new.join(jobs.select("clip_id", "job", "a_us"), ["clip_id", "job"])
    add = add.withColumn("start_us", F.col("start_us") + F.col("a_us")).withColumn("end_us", F.col("end_us") + F.col("a_us"))
    return Ordered(KEY, ["start_us"], blocks).number(rest.select(*cols).unionByName(add.select(*cols)), "seg")
