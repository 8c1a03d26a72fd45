"""Object candidates, masks and grounded identities.

A frame holds a bounded number of detections; candidates meet only inside their frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import masks as M
from ..plans.folds import ordered_fold

_U64 = 0xFFFFFFFFFFFFFFFF


def restrict_vocab(inventory: DataFrame, verified: DataFrame) -> DataFrame:
    """Inventory without fixtures, kept to the verified names unless a clip would lose them all."""
    inv = inventory.where(F.coalesce("role", F.lit("manipulable")) != "fixture")
    v = verified.select("clip_id", "name").distinct().withColumn("_v", F.lit(1))
    j = inv.join(v, ["clip_id", "name"], "left")
    any_ok = j.groupBy("clip_id").agg(F.max(F.coalesce("_v", F.lit(0))).alias("_any"))
    return j.join(any_ok, "clip_id").where((F.col("_v") == 1) | (F.col("_any") == 0)).select(*inventory.columns)


def dropped_names(proposed: DataFrame, verified: DataFrame) -> DataFrame:
    """Proposed names of a clip that were not verified."""
    return proposed.select("clip_id", "name").distinct().join(verified, ["clip_id", "name"], "left_anti")


def provenance_values(rows: DataFrame, column: str = "src") -> DataFrame:
    """Distinct provenance values, for a legend."""
    return rows.select(column).where(F.col(column).isNotNull()).distinct()


def filter_candidates(c: DataFrame, min_area: float = 0.0002, max_area: float = 0.40, max_on_hand: float = 0.70) -> DataFrame:
    """Geometry gate: area in range, touching the box, not on the wrist, not mostly on the hand.
    Columns: ``area`` (share of the picture), ``in_box``, ``on_wrist`` (0/1), ``on_hand`` (share)."""
    ok = (F.col("area") > min_area) & (F.col("area") < max_area) & (F.col("in_box") == 1) & (F.col("on_wrist") == 0)
    return c.where(ok & (F.coalesce("on_hand", F.lit(0.0)) <= max_on_hand))


def manip_score(dist: Column, on_hand: Column, area: Column, score: Column, variant: str = "nearest") -> Column:
    """Manipulation confidence from distance to the grasp, share on the hand, size and detector score."""
    reach, weights = {"nearest": (1.2, (0.42, 0.30, 0.12, 0.16)), "centroid": (2.0, (0.40, 0.27, 0.15, 0.18))}[variant]
    prox = F.greatest(F.lit(0.0), 1.0 - dist / reach)
    sized = F.when(area < 0.12, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (area - 0.12) / 0.18))
    wp, wh, ws, wd = weights
    return prox * wp + (1.0 - on_hand) * wh + sized * ws + score * wd


def tier(obj: Column, low_conf: Column) -> Column:
    return F.when(obj == 0, "na").when(F.coalesce(low_conf, F.lit(0)) == 1, "low").otherwise("ok")


def assign_sides(hands: DataFrame, key: list[str], width: int) -> DataFrame:
    """Two or more hands by x: left, right (others dropped); a single one by the half it is in."""
    w = Window.partitionBy(*key)
    h = hands.withColumn("_r", F.row_number().over(w.orderBy("x", "hand_id")))
    n = hands.groupBy(*key).agg(F.count("*").alias("_n"))
    h = h.where(F.col("_r") <= 2).join(n, key)
    side = F.when(F.col("_n") >= 2, F.when(F.col("_r") == 1, "left").otherwise("right")).otherwise(F.when(F.col("x") * 2 < width, "left").otherwise("right"))
    return h.withColumn("side", side).drop("_r", "_n")


def trusted_single(c: DataFrame, key: list[str], thr: float = 0.6) -> DataFrame:
    """Accept a name when exactly one candidate name reaches the threshold."""
    strong = c.where((F.col("score") >= thr) & F.col("name").isNotNull())
    g = strong.groupBy(*key).agg(F.count_distinct("name").alias("n"), F.min("name").alias("_name"))
    all_keys = c.select(*key).distinct()
    return all_keys.join(g, key, "left").select(*key, F.when(F.col("n") == 1, F.col("_name")).alias("name"), F.when(F.col("n") == 1, "trusted").otherwise("ambiguous").alias("how"))


def auto_accept(manip: Column, grip: Column, on_hand: Column, dist: Column, touches: Column, anchored: Column) -> Column:
    """Clearly held: strong candidate, closed grip, off the hand, near, and both contact flags set."""
    return (
        (manip >= 0.75) & (F.coalesce(grip, F.lit(1.0)) < 0.40) & (on_hand < 0.35) & (dist < 0.4) & (touches == 1) & (anchored == 1)
    )


def forced_pick(c: DataFrame, gate: DataFrame, key: list[str]) -> DataFrame:
    """Where the gate says yes and nothing was chosen, take the top-ranked candidate, named by the fallback."""
    top = c.groupBy(*key).agg(F.max_by(F.struct("cand", "name"), F.struct("score", -F.col("cand"))).alias("t"))
    j = gate.join(top, key, "left")
    hit = (F.col("gate") == 1) & F.col("chosen").isNull() & F.col("t").isNotNull()
    name = F.coalesce(F.nullif(F.col("t.name"), F.lit("")), F.col("fallback"))
    take = hit & name.isNotNull()
    return j.select(
        *key,
        F.when(take, F.col("t.cand")).otherwise(F.col("chosen")).alias("chosen"),
        F.when(take, name).otherwise(F.col("name_chosen")).alias("name"),
        F.when(take, "gate-pick").otherwise(F.when(F.col("chosen").isNotNull(), "llm")).alias("src"),
    )


# ---- mask joins ------------------------------------------------------------------------------------
def best_overlap(hands: DataFrame, objects: DataFrame, key: list[str]) -> DataFrame:
    """Object overlapping each hand most; it must overlap at all, the first (``ord``) wins ties."""
    o = objects.select(*key, F.col("ord").alias("o_ord"), F.col("name").alias("object"), F.col("mask").alias("o_mask"))
    j = hands.join(o, key).withColumn("ov", M.overlap(F.col("mask"), F.col("o_mask"))).where(F.col("ov") > 0)
    return j.groupBy(*key, "hand").agg(F.max_by(F.struct("object", "ov"), F.struct("ov", -F.col("o_ord"))).alias("b")).select(*key, "hand", "b.object", "b.ov")


def name_by_overlap(masks: DataFrame, tracks: DataFrame, key: list[str], thr: float = 0.30, mode: str = "argmax") -> DataFrame:
    """Name a mask by the track holding more than ``thr`` of it: the best one, or the first one."""
    t = tracks.select(*key, F.col("ord").alias("t_ord"), F.col("name").alias("track"), F.col("mask").alias("t_mask"))
    j = masks.select(*key, "cand", "mask").join(t, key).withColumn("f", M.inside_fraction(F.col("mask"), F.col("t_mask"))).where(F.col("f") > thr)
    by = F.struct("f", -F.col("t_ord")) if mode == "argmax" else F.struct(-F.col("t_ord"))
    named = j.groupBy(*key, "cand").agg(F.max_by("track", by).alias("name"))
    return masks.select(*key, "cand").join(named, [*key, "cand"], "left")


def gate_and_track(prompts: DataFrame, gate: DataFrame, tracks: DataFrame) -> DataFrame:
    """Hand and time (to 0.1 s) look up the gate; when it is true the smallest qualifying track names the
    hand, else the gate's own name."""
    t01 = lambda c: F.floor((F.col(c) + 50_000) / 100_000).cast("long")
    g = gate.select("clip_id", "hand", t01("t_us").alias("_t"), "obj", F.col("name").alias("pf_name"))
    p = prompts.withColumn("_t", t01("t_us"))
    small = tracks.where(F.col("ok") == 1).groupBy("clip_id", "t_us", "hand").agg(F.min_by("name", F.struct("area", "ord")).alias("tr_name"))
    j = p.join(g, ["clip_id", "hand", "_t"], "left").join(small, ["clip_id", "t_us", "hand"], "left")
    on = F.coalesce(F.col("obj") == 1, F.lit(False))
    return j.select(
        "clip_id", "t_us", "hand",
        F.when(~on, "N/A").otherwise(F.coalesce("tr_name", "pf_name")).alias("name"),
        F.when(~on, "").when(F.col("tr_name").isNotNull(), "track").otherwise("perframe").alias("src"),
    )


def grasp_filter(c: DataFrame, regions: DataFrame) -> DataFrame:
    """Names whose mask meets a hand region in some frame; all names of a clip without regions."""
    r = regions.select("clip_id", "frame", F.col("mask").alias("r_mask"))
    hit = c.join(r, ["clip_id", "frame"]).where(M.meets(F.col("mask"), F.col("r_mask"))).select("clip_id", "name").distinct()
    names = c.select("clip_id", "name").distinct()
    bare = names.join(regions.select("clip_id").distinct(), "clip_id", "left_anti")
    return names.join(hit, ["clip_id", "name"], "left_semi").union(bare)


def shared_object(grounded: DataFrame, key: list[str], thr: float = 0.2) -> DataFrame:
    """Both hands with one name and masks overlapping by more than ``thr`` of the smaller: one row."""
    side = lambda h: grounded.where(F.col("hand") == h).select(*key, "name", F.col("mask").alias(f"{h}_mask"))
    j = side("left").join(side("right"), [*key, "name"])
    l, r = F.col("left_mask"), F.col("right_mask")
    return j.where(M.overlap(l, r) > F.least(M.area(l), M.area(r)) * thr).select(*key, "name", M.union(l, r).alias("mask"))


def mask_union(masks: DataFrame, key: list[str]) -> DataFrame:
    """Union of all instances' masks per key."""
    w = masks.select(*key, F.posexplode("mask").alias("pos", "word")).groupBy(*key, "pos").agg(F.bit_or("word").alias("word"))
    s = F.sort_array(F.collect_list(F.struct("pos", "word")))
    return w.groupBy(*key).agg(F.transform(s, lambda x: x["word"]).alias("mask"))


def best_view(c: DataFrame, max_area: int) -> DataFrame:
    """Best score per clip and name, and where it was; only masks smaller than ``max_area`` cells, first wins ties."""
    ok = c.where((M.area(F.col("mask")) > 0) & (M.area(F.col("mask")) < max_area) & (F.col("score") > 0))
    b = ok.groupBy("clip_id", "name").agg(F.max_by(F.struct("frame", "cand", "score"), F.struct("score", -F.col("frame"), -F.col("cand"))).alias("b"))
    return b.select("clip_id", "name", "b.frame", "b.cand", "b.score")


def grounding_counts(index: DataFrame) -> DataFrame:
    """Grounded, low-confidence and N/A rows by clip and source."""
    g = F.col("obj") == 1
    return index.groupBy("clip_id", "src").agg(
        F.count_if(g).alias("grounded"), F.count_if(g & (F.col("low_conf") == 1)).alias("low"), F.count_if(~g).alias("na")
    )


def object_coverage(rows: DataFrame) -> DataFrame:
    """Distinct times each object is present."""
    return rows.groupBy("clip_id", "name").agg(F.count_distinct("t_us").alias("times"))


def mask_iou(pred: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """IoU per condition, missing when either mask is."""
    t = truth.select(*key, F.col("mask").alias("t_mask"))
    j = pred.join(t, key, "left")
    u = M.union_area(F.col("mask"), F.col("t_mask"))
    return j.select(*key, "condition", F.try_divide(M.overlap(F.col("mask"), F.col("t_mask")).cast("double"), F.nullif(u, F.lit(0))).alias("iou"))


# ---- greedy selections inside a frame ---------------------------------------------------------------
def _greedy(c: DataFrame, key: list[str], order: str, clash, cap: int | None) -> DataFrame:
    def fold(rows):
        kept: list[tuple] = []
        for cand, words in rows:
            m = tuple(w & _U64 for w in words)
            a = sum(w.bit_count() for w in m)
            if any(clash(a, ka, sum((x & y).bit_count() for x, y in zip(m, km))) for ka, km in kept):
                continue
            kept.append((a, m))
            yield cand, len(kept)
            if cap is not None and len(kept) >= cap:
                break

    return ordered_fold(c, key, [order, "cand"], ["cand", "mask"], "cand long, rank long", fold)


def nms(c: DataFrame, key: list[str], thr_pct: int = 80, cap: int | None = None) -> DataFrame:
    """By score, keep a mask whose IoU with every kept one is below ``thr_pct`` percent; with its rank, and
    the first ``cap`` only where one is given."""
    c = c.withColumn("_ord", -F.col("score"))
    return _greedy(c, key, "_ord", lambda a, b, i: i * 100 >= thr_pct * (a + b - i) if a + b - i else False, cap)


def drop_contained(c: DataFrame, key: list[str], thr_pct: int = 80) -> DataFrame:
    """Largest first; drop a mask lying more than ``thr_pct`` percent inside a kept one."""
    c = c.withColumn("_ord", -M.area(F.col("mask")))
    return _greedy(c, key, "_ord", lambda a, b, i: i * 100 > thr_pct * a, None)


def dedup_regions(c: DataFrame, key: list[str], thr_pct: int = 70) -> DataFrame:
    """In input order (``ord``); drop a mask sharing ``thr_pct`` percent of the smaller with a kept one."""
    return _greedy(c, key, "ord", lambda a, b, i: i * 100 >= thr_pct * min(a, b), None)


# ---- temporal carry ----------------------------------------------------------------------------------
def rank_neighbours(rows: DataFrame) -> DataFrame:
    """Order of a segment's other frames: named by the chooser first, then confidence, then closeness."""
    prim = rows.where(F.col("primary") == 1).groupBy("clip_id", "seg_id").agg(F.min("t_us").alias("_pt"))
    n = rows.where((F.col("primary") == 0) & (F.col("obj") == 1)).join(prim, ["clip_id", "seg_id"])
    w = Window.partitionBy("clip_id", "seg_id").orderBy((F.col("src") != "llm").cast("int"), F.desc("conf"), F.abs(F.col("t_us") - F.col("_pt")), "t_us")
    return n.withColumn("rank", F.row_number().over(w)).drop("_pt")


def temporal_carry(rows: DataFrame, thr: int = 60) -> DataFrame:
    """Fill a primary N/A from the best trusted neighbour, unless the gate was certain (no vote for either
    question).  ``conf`` in hundredths."""
    best = rank_neighbours(rows.where((F.col("primary") == 1) | (F.col("conf") >= thr))).where(F.col("rank") == 1)
    best = best.select("clip_id", "seg_id", F.col("name").alias("_n"), F.col("conf").alias("_c"))
    j = rows.where(F.col("primary") == 1).join(best, ["clip_id", "seg_id"], "left")
    solid = (F.col("gate") == 0) & (F.col("q1") == 0) & (F.col("q2") == 0)
    fill = (F.col("obj") == 0) & ~solid & F.col("_n").isNotNull()
    return j.select(
        "clip_id", "seg_id", "t_us",
        F.when(fill, 1).otherwise(F.col("obj")).alias("obj"),
        F.when(fill, F.col("_n")).otherwise(F.col("name")).alias("name"),
        F.when(fill, F.col("_c")).otherwise(F.col("conf")).alias("conf"),
        F.when(fill, "temporal").otherwise(F.col("src")).alias("src"),
    )
