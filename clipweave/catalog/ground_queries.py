"""Candidates, masks, grounded identities and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import masks as M
from ..operators import evaluation as E
from ..operators import grounding as D
from ..operators import joins as J
from .registry import query
from .text_queries import SECTXT
from .views import DAY, U

MK = """v_mk AS (SELECT vec_id // 20 AS frame, vec_id AS cand, label, 'object ' || label AS name, CAST(floor(abs(CAST(embedding[1] AS DOUBLE)) * 1000000) AS BIGINT) AS score,
 list_reduce(list_transform(range(64), lambda i: CASE WHEN embedding[i+1] > 0 THEN CAST(1 AS HUGEINT) << CAST(i AS HUGEINT) ELSE CAST(0 AS HUGEINT) END), lambda a, b: a | b) AS mask FROM embeddings)"""


def mk(v):
    """One-word masks, twenty candidates to a frame."""
    m = v.masks()
    return m.select("frame", "cand", F.split_part("name", F.lit(" "), F.lit(2)).cast("int").alias("label"), "name", "score", F.array("mask").alias("mask"))


@query("candidate_areas", "SELECT cand, bit_count(mask) AS area FROM v_mk", MK)
def _(v):
    return mk(v).select("cand", M.area(F.col("mask")).alias("area"))


@query(
    "mask_iou_and_containment",
    "SELECT a.frame, a.cand AS a, b.cand AS b, CAST(bit_count(a.mask & b.mask) AS DOUBLE) / bit_count(a.mask | b.mask) AS iou, CAST(bit_count(a.mask & b.mask) AS DOUBLE) / bit_count(a.mask) AS inside FROM v_mk a JOIN v_mk b ON b.cand = a.cand + 1 AND a.frame = b.frame",
    MK,
)
def _(v):
    a = mk(v).select("frame", F.col("cand").alias("a"), "mask")
    b = mk(v).select("frame", F.col("cand").alias("b"), (F.col("cand") - 1).alias("a"), F.col("mask").alias("m2"))
    return a.join(b, ["frame", "a"]).select("frame", "a", "b", M.iou(F.col("mask"), F.col("m2")).alias("iou"), M.inside_fraction(F.col("mask"), F.col("m2")).alias("inside"))


@query("mask_union", "SELECT frame, name, bit_count(bit_or(mask)) AS area FROM v_mk GROUP BY 1, 2", MK)
def _(v):
    return D.mask_union(mk(v), ["frame", "name"]).select("frame", "name", M.area(F.col("mask")).alias("area"))


@query("best_view", "SELECT clip_id, name, b.frame AS frame, b.cand AS cand, b.score AS score FROM (SELECT frame // 3 AS clip_id, name, arg_max({'frame': frame, 'cand': cand, 'score': score}, {'s': score, 'f': -frame, 'c': -cand}) AS b FROM v_mk WHERE bit_count(mask) > 0 AND bit_count(mask) < 33 AND score > 0 GROUP BY 1, 2)", MK)
def _(v):
    return D.best_view(mk(v).withColumn("clip_id", F.expr("frame div 3")), 33)


def _greedy_sql(order, clash, cap, name):
    """Frame by frame, candidate by candidate, carrying the kept masks."""
    bad = f"len(list_filter(f.kept, lambda z: {clash})) > 0"
    full = f"len(f.kept) >= {cap}" if cap else "false"
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY {order}, cand) AS i FROM v_mk),
{name} AS (SELECT frame, i, cand, true AS keep, [mask] AS kept FROM {name}_n WHERE i = 1
 UNION ALL SELECT n.frame, n.i, n.cand, NOT ({bad} OR {full}), CASE WHEN {bad} OR {full} THEN f.kept ELSE list_append(f.kept, n.mask) END FROM {name} f JOIN {name}_n n ON n.frame = f.frame AND n.i = f.i + 1)"""


_KEPT = "SELECT frame, cand, len(kept) AS rank FROM {n} WHERE keep"


@query("non_maximum_suppression", _KEPT.format(n="nm5"), MK, _greedy_sql("-score", "1::BIGINT * bit_count(z & n.mask) * 100 >= 40 * 1::BIGINT * bit_count(z | n.mask)", None, "nm5"))
def _(v):
    return D.nms(mk(v), ["frame"], 40)


@query("drop_contained", _KEPT.format(n="dc"), MK, _greedy_sql("-bit_count(mask)", "1::BIGINT * bit_count(z & n.mask) * 100 > 65 * 1::BIGINT * bit_count(n.mask)", None, "dc"))
def _(v):
    return D.drop_contained(mk(v), ["frame"], 65)


@query("dedup_regions", _KEPT.format(n="dr"), MK, _greedy_sql("cand", "1::BIGINT * bit_count(z & n.mask) * 100 >= 65 * least(1::BIGINT * bit_count(z), 1::BIGINT * bit_count(n.mask))", None, "dr"))
def _(v):
    return D.dedup_regions(mk(v).withColumn("ord", F.col("cand")), ["frame"], 65)


# labels below 3 are hands, the others objects
@query(
    "best_overlap",
    "SELECT frame, hand, b.o AS object, b.v AS ov FROM (SELECT h.frame, h.cand AS hand, arg_max({'o': o.name, 'v': bit_count(h.mask & o.mask)}, {'v': bit_count(h.mask & o.mask), 'c': -o.cand}) AS b FROM v_mk h JOIN v_mk o ON o.frame = h.frame AND h.label < 3 AND o.label >= 3 AND bit_count(h.mask & o.mask) > 0 GROUP BY 1, 2)",
    MK,
)
def _(v):
    m = mk(v)
    h = m.where("label < 3").select("frame", F.col("cand").alias("hand"), "mask")
    return D.best_overlap(h, m.where("label >= 3").withColumn("ord", F.col("cand")), ["frame"])


for _mode, _by in (("argmax", "{'f': CAST(bit_count(h.mask & o.mask) AS DOUBLE) / bit_count(h.mask), 'c': -o.cand}"), ("first", "-o.cand")):

    @query(
        f"name_by_overlap_{_mode}",
        f"SELECT m.frame, m.cand, name FROM (SELECT frame, cand FROM v_mk WHERE label < 3) m LEFT JOIN (SELECT h.frame, h.cand, arg_max(o.name, {_by}) AS name FROM v_mk h JOIN v_mk o ON o.frame = h.frame AND h.label < 3 AND o.label >= 3 AND CAST(bit_count(h.mask & o.mask) AS DOUBLE) / bit_count(h.mask) > 0.6 GROUP BY 1, 2) n ON n.frame = m.frame AND n.cand = m.cand",
        MK,
    )
    def _(v, mode=_mode):
        m = mk(v)
        return D.name_by_overlap(m.where("label < 3"), m.where("label >= 3").withColumn("ord", F.col("cand")), ["frame"], 0.6, mode)


@query(
    "grasp_filter",
    "SELECT DISTINCT c.frame // 5 AS clip_id, c.name FROM v_mk c JOIN v_mk r ON r.frame = c.frame AND r.label < 1 AND c.label >= 1 AND (c.mask & r.mask) <> 0 UNION SELECT DISTINCT frame // 5, name FROM v_mk WHERE label >= 1 AND frame // 5 NOT IN (SELECT frame // 5 FROM v_mk WHERE label < 1)",
    MK,
)
def _(v):
    m = mk(v).withColumn("clip_id", F.floor(F.col("frame") / 5))
    return D.grasp_filter(m.where("label >= 1"), m.where("label < 1"))


@query("shared_object", "SELECT a.frame, a.cand, a.name, 1::BIGINT * bit_count(a.mask | b.mask) AS area FROM v_mk a JOIN v_mk b ON b.frame = a.frame AND b.cand = a.cand + 1 AND b.label = a.label AND 1::BIGINT * bit_count(a.mask & b.mask) * 5 > least(1::BIGINT * bit_count(a.mask), 1::BIGINT * bit_count(b.mask))", MK)
def _(v):
    m = mk(v)
    l = m.select("frame", "cand", "name", "mask", F.lit("left").alias("hand"))
    r = m.select("frame", (F.col("cand") - 1).alias("cand"), "name", "mask", F.lit("right").alias("hand"))
    return D.shared_object(l.union(r), ["frame", "cand"]).select("frame", "cand", "name", M.area(F.col("mask")).alias("area"))


_COND = "CASE WHEN p.score >= 100000 THEN 'high' ELSE 'low' END"


@query("mask_iou_by_condition", f"SELECT p.frame, p.cand, {_COND} AS condition, CAST(bit_count(p.mask & t.mask) AS DOUBLE) / bit_count(p.mask | t.mask) AS iou FROM v_mk p LEFT JOIN v_mk t ON t.frame = p.frame AND t.cand = p.cand + 2", MK)
def _(v):
    p = mk(v).withColumn("condition", F.when(F.col("score") >= 100_000, "high").otherwise("low"))
    t = mk(v).withColumn("cand", F.col("cand") - 2)
    return D.mask_iou(p.select("frame", "cand", "condition", "mask"), t, ["frame", "cand"])


# ---- candidates from events: geometry columns in fixed fractions ---------------------------------------
CAND = """v_cand AS (SELECT clip_id, t_us, event_id AS cand, k, event_type, CASE WHEN event_type <> 'error' THEN event_type END AS name, k / 100.0::DOUBLE AS score, (k % 50) / 100.0::DOUBLE AS area, (k % 30) / 20.0::DOUBLE AS dist, (k % 11) / 10.0::DOUBLE AS on_hand,
 CAST(k % 7 > 0 AS INT) AS in_box, CAST(k % 9 = 0 AS INT) AS on_wrist, t_us // 86400000000 AS day FROM v_obs)"""


def cand(v):
    k = F.col("k")
    return v.obs().select(
        "clip_id", "t_us", F.col("event_id").alias("cand"), "k", "event_type", F.when(F.col("event_type") != "error", F.col("event_type")).alias("name"),
        (k / 100.0).alias("score"), ((k % 50) / 100.0).alias("area"), ((k % 30) / 20.0).alias("dist"), ((k % 11) / 10.0).alias("on_hand"),
        (k % 7 > 0).cast("int").alias("in_box"), (k % 9 == 0).cast("int").alias("on_wrist"), F.expr("t_us div 86400000000").alias("day"),
    )


@query("filter_candidates", "SELECT clip_id, cand FROM v_cand WHERE area > 0.0002 AND area < 0.40 AND in_box = 1 AND on_wrist = 0 AND on_hand <= 0.70", CAND)
def _(v):
    return D.filter_candidates(cand(v)).select("clip_id", "cand")


_PROX = "greatest(0.0, 1.0 - dist / {r}::DOUBLE)"
_SIZED = "CASE WHEN area < 0.12 THEN 1.0 ELSE greatest(0.0, 1.0 - (area - 0.12::DOUBLE) / 0.18::DOUBLE) END"
_MS = "({p} * {a}::DOUBLE + (1.0 - on_hand) * {b}::DOUBLE + " + _SIZED + " * {c}::DOUBLE + score * {d}::DOUBLE)"
_M1 = _MS.format(p=_PROX.format(r="1.2"), a="0.42", b="0.30", c="0.12", d="0.16")
_M2 = _MS.format(p=_PROX.format(r="2.0"), a="0.40", b="0.27", c="0.15", d="0.18")


@query("manipulation_scores", f"SELECT cand, round({_M1}, 6) AS nearest, round({_M2}, 6) AS centroid FROM v_cand", CAND)
def _(v):
    c = [F.col(x) for x in ("dist", "on_hand", "area", "score")]
    return cand(v).select("cand", F.round(D.manip_score(*c), 6).alias("nearest"), F.round(D.manip_score(*c, "centroid"), 6).alias("centroid"))


@query("auto_accept", f"SELECT cand, CAST({_M1} >= 0.75 AND coalesce(CASE WHEN k % 4 > 0 THEN k / 200.0::DOUBLE END, 1.0) < 0.40 AND on_hand < 0.35 AND dist < 0.4 AND in_box = 1 AND on_wrist = 0 AS INT) AS accept FROM v_cand", CAND)
def _(v):
    grip = F.when(F.col("k") % 4 > 0, F.col("k") / 200.0)
    m = D.manip_score(F.col("dist"), F.col("on_hand"), F.col("area"), F.col("score"))
    ok = D.auto_accept(m, grip, F.col("on_hand"), F.col("dist"), F.col("in_box"), (F.col("on_wrist") == 0).cast("int"))
    return cand(v).select("cand", ok.cast("int").alias("accept"))


@query("confidence_tiers", "SELECT cand, CASE WHEN name IS NULL THEN 'na' WHEN k < 60 THEN 'low' ELSE 'ok' END AS tier FROM v_cand", CAND)
def _(v):
    return cand(v).select("cand", D.tier(F.col("name").isNotNull().cast("int"), (F.col("k") < 60).cast("int")).alias("tier"))


@query("assign_sides", "SELECT clip_id, day, cand, CASE WHEN n >= 2 THEN CASE WHEN r = 1 THEN 'left' ELSE 'right' END WHEN k * 2 < 100 THEN 'left' ELSE 'right' END AS side FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, day ORDER BY k, cand) AS r, count(*) OVER (PARTITION BY clip_id, day) AS n FROM v_cand) WHERE r <= 2", CAND)
def _(v):
    h = cand(v).select("clip_id", "day", F.col("cand"), F.col("cand").alias("hand_id"), F.col("k").alias("x"))
    return D.assign_sides(h, ["clip_id", "day"], 100).select("clip_id", "day", "cand", "side")


@query("trusted_single", "SELECT clip_id, day, CASE WHEN n = 1 THEN nm END AS name, CASE WHEN n = 1 THEN 'trusted' ELSE 'ambiguous' END AS how FROM (SELECT clip_id, day, count(DISTINCT name) FILTER (score >= 0.6) AS n, min(name) FILTER (score >= 0.6) AS nm FROM v_cand GROUP BY 1, 2)", CAND)
def _(v):
    return D.trusted_single(cand(v), ["clip_id", "day"])


@query(
    "forced_pick",
    """SELECT g.clip_id, g.day, CASE WHEN gate = 1 AND chosen IS NULL AND coalesce(t.n, 'thing') IS NOT NULL THEN t.c ELSE chosen END AS chosen, CASE WHEN gate = 1 AND chosen IS NULL THEN coalesce(t.n, 'thing') WHEN chosen IS NOT NULL THEN 'chosen' END AS name,
 CASE WHEN gate = 1 AND chosen IS NULL THEN 'gate-pick' WHEN chosen IS NOT NULL THEN 'llm' END AS src FROM (SELECT clip_id, day, CAST(max(k) >= 50 AS INT) AS gate, min(cand) FILTER (k % 5 = 0) AS chosen, arg_max({'c': cand, 'n': name}, {'s': score, 'c': -cand}) AS t FROM v_cand GROUP BY 1, 2) g""",
    CAND,
)
def _(v):
    c = cand(v)
    g = c.groupBy("clip_id", "day").agg((F.max("k") >= 50).cast("int").alias("gate"), F.min(F.when(F.col("k") % 5 == 0, F.col("cand"))).alias("chosen"))
    g = g.withColumn("fallback", F.lit("thing")).withColumn("name_chosen", F.when(F.col("chosen").isNotNull(), "chosen"))
    return D.forced_pick(c, g, ["clip_id", "day"])


@query(
    "restrict_vocab",
    """SELECT i.clip_id, i.name FROM (SELECT DISTINCT clip_id, event_type AS name FROM v_obs WHERE event_type <> 'error') i WHERE EXISTS (SELECT 1 FROM v_obs o WHERE o.clip_id = i.clip_id AND o.event_type = i.name AND o.k = 99)
 OR NOT EXISTS (SELECT 1 FROM v_obs o WHERE o.clip_id = i.clip_id AND o.event_type <> 'error' AND o.k = 99)""",
)
def _(v):
    inv = v.obs().select("clip_id", F.col("event_type").alias("name"), F.when(F.col("event_type") == "error", "fixture").otherwise("manipulable").alias("role")).distinct()
    ok = v.obs().where("k = 99").select("clip_id", F.col("event_type").alias("name"))
    return D.restrict_vocab(inv, ok).select("clip_id", "name")


@query("dropped_names", "SELECT DISTINCT clip_id, event_type AS name FROM v_obs o WHERE NOT EXISTS (SELECT 1 FROM v_obs p WHERE p.clip_id = o.clip_id AND p.event_type = o.event_type AND p.k = 99)")
def _(v):
    names = v.obs().select("clip_id", F.col("event_type").alias("name"), "k")
    return D.dropped_names(names, names.where("k = 99"))


@query("provenance_values", "SELECT DISTINCT CASE WHEN k < 60 THEN 'llm' WHEN k < 90 THEN event_type END AS src FROM v_obs WHERE k < 90")
def _(v):
    return D.provenance_values(v.obs().select(F.when(F.col("k") < 60, "llm").when(F.col("k") < 90, F.col("event_type")).alias("src")))


@query(
    "gate_and_track",
    """SELECT o.clip_id, o.t_us, 'left' AS hand, CASE WHEN coalesce(g.event_type <> 'error', false) THEN coalesce(CASE WHEN o.k >= 50 THEN o.event_type END, g.event_type) ELSE 'N/A' END AS name,
 CASE WHEN coalesce(g.event_type <> 'error', false) THEN CASE WHEN o.k >= 50 THEN 'track' ELSE 'perframe' END ELSE '' END AS src FROM v_obs o LEFT JOIN v_obs g ON g.clip_id = o.clip_id AND g.k < 90 AND (g.t_us + 50000) // 100000 = (o.t_us + 50000) // 100000""",
)
def _(v):
    o = v.obs().withColumn("hand", F.lit("left"))
    gate = o.where("k < 90").select("clip_id", "hand", "t_us", (F.col("event_type") != "error").cast("int").alias("obj"), F.col("event_type").alias("name"))
    tr = o.select("clip_id", "t_us", "hand", F.col("event_type").alias("name"), (F.col("k") >= 50).cast("int").alias("ok"), F.col("k").alias("area"), F.col("event_id").alias("ord"))
    return D.gate_and_track(o.select("clip_id", "t_us", "hand"), gate, tr)


@query("grounding_counts", "SELECT clip_id, left_touching AS src, count(*) FILTER (event_type <> 'error') AS grounded, count(*) FILTER (event_type <> 'error' AND k < 60) AS low, count(*) FILTER (event_type = 'error') AS na FROM v_obs GROUP BY 1, 2")
def _(v):
    i = v.obs().select("clip_id", F.col("left_touching").alias("src"), (F.col("event_type") != "error").cast("int").alias("obj"), (F.col("k") < 60).cast("int").alias("low_conf"))
    return D.grounding_counts(i)


@query("object_coverage", "SELECT clip_id, right_touching AS name, count(DISTINCT t_us // 86400000000) AS times FROM v_obs GROUP BY 1, 2")
def _(v):
    return D.object_coverage(v.obs().select("clip_id", F.col("right_touching").alias("name"), F.expr("t_us div 86400000000").alias("t_us")))


# a segment id every three frames; its primary is the middle frame
CARRY = """v_ix AS (SELECT clip_id, frame // 3 AS sid, t_us, CAST(frame % 3 = 1 AS INT) AS prim, CAST(event_type NOT IN ('error','view') AS INT) AS obj, event_type AS name, CAST(k AS INT) AS conf, CASE WHEN k % 2 = 0 THEN 'llm' ELSE 'track' END AS src,
 CAST(k % 3 > 0 AS INT) AS gate, k % 2 AS q1, k % 4 AS q2 FROM v_frames),
v_rk AS (SELECT n.*, row_number() OVER (PARTITION BY n.clip_id, n.sid ORDER BY CAST(n.src <> 'llm' AS INT), n.conf DESC, abs(n.t_us - p.t_us), n.t_us) AS rank FROM v_ix n JOIN v_ix p ON p.clip_id = n.clip_id AND p.sid = n.sid AND p.prim = 1 WHERE n.prim = 0 AND n.obj = 1)"""


def index_rows(v):
    k = F.col("k")
    return v.frames().select(
        "clip_id", F.floor(F.col("frame") / 3).alias("seg_id"), "t_us", (F.col("frame") % 3 == 1).cast("int").alias("primary"), (~F.col("event_type").isin("error", "view")).cast("int").alias("obj"),
        F.col("event_type").alias("name"), k.alias("conf"), F.when(k % 2 == 0, "llm").otherwise("track").alias("src"), (k % 3 > 0).cast("int").alias("gate"), (k % 2).alias("q1"), (k % 4).alias("q2"),
    )


@query("rank_neighbours", "SELECT clip_id, sid AS seg_id, t_us, rank FROM v_rk", CARRY)
def _(v):
    return D.rank_neighbours(index_rows(v)).select("clip_id", "seg_id", "t_us", "rank")


@query(
    "temporal_carry",
    """SELECT p.clip_id, p.sid AS seg_id, p.t_us, CASE WHEN f THEN 1 ELSE obj END AS obj, CASE WHEN f THEN bn ELSE name END AS name, CASE WHEN f THEN bc ELSE conf END AS conf, CASE WHEN f THEN 'temporal' ELSE src END AS src FROM (
 SELECT p.*, b.name AS bn, b.conf AS bc, p.obj = 0 AND NOT (p.gate = 0 AND p.q1 = 0 AND p.q2 = 0) AND b.name IS NOT NULL AS f FROM v_ix p LEFT JOIN (SELECT clip_id, sid, arg_min(name, rank) AS name, arg_min(conf, rank) AS conf FROM v_rk WHERE conf >= 60 GROUP BY 1,2) b ON b.clip_id = p.clip_id AND b.sid = p.sid WHERE p.prim = 1) p""",
    CARRY,
)
def _(v):
    return D.temporal_carry(index_rows(v))


# ---- keypoint geometry ------------------------------------------------------------------------------------
@query("mirror_points", "SELECT event_id, greatest(10, least(10 + (60 + k) - k, 10, 99999)) * 0 + greatest(10, least(70 + k - k, least(60 + k, 89))) AS mx, greatest(5, least(5 + 80 - k, least(80, 99))) AS my FROM v_obs".replace("greatest(10, least(10 + (60 + k) - k, 10, 99999)) * 0 + ", ""))
def _(v):
    k = F.col("k")
    x, y = G.mirror_point(k, k, [F.lit(10), F.lit(5), 60 + k, F.lit(80)], F.lit(90), F.lit(100))
    return v.obs().select("event_id", x.alias("mx"), y.alias("my"))


@query("box_overlap", "SELECT event_id, round(CAST(i AS DOUBLE) / ((10 + k) * 20 + 30 * 15 - i), 9) AS iou FROM (SELECT event_id, k, greatest(0, least(10 + k, 40) - 10) * greatest(0, least(20, 20) - 5) AS i FROM v_obs)")
def _(v):
    k = F.col("k")
    lit = F.lit
    return v.obs().select("event_id", F.round(M.box_iou([lit(0), lit(0), 10 + k, lit(20)], [lit(10), lit(5), lit(40), lit(20)]), 9).alias("iou"))


@query("grip_ratio", "SELECT event_id, CASE WHEN k >= 20 THEN round(sqrt(CAST((4 * k) * (4 * k) + (8 * k) * (8 * k) AS DOUBLE)) / greatest(1.0, sqrt(CAST(100 * 100 + 50 * 50 AS DOUBLE))), 9) END AS grip FROM v_obs")
def _(v):
    # tip i at (k·i, 2·k·i); with k below 20 only two tips are confident
    k = F.col("k")
    tip = {j: i for i, j in enumerate(G.TIPS)}
    pts = [F.struct((k * tip.get(j, 0)).cast("double").alias("x"), (k * tip.get(j, 0) * 2).cast("double").alias("y"), (F.lit(0.9) if tip.get(j, 9) < 2 else F.when(k >= 20, 0.8).otherwise(0.1)).alias("conf")) for j in range(21)]
    return v.obs().select("event_id", F.round(G.grip_ratio(F.array(*pts), [F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(50.0)]), 9).alias("grip"))


# ---- evaluation -------------------------------------------------------------------------------------------------
TOL = U // 120


def match_sql(truth, det, tol, name):
    return f"""{name}_e AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY pos, side) AS i FROM (SELECT clip_id, t_us AS pos, 0 AS side, t_us FROM {det} UNION ALL SELECT clip_id, t_us + {tol}, 1, t_us FROM {truth})),
{name}_f AS (SELECT clip_id, i, side, t_us, CASE WHEN side = 0 THEN [t_us] ELSE CAST([] AS BIGINT[]) END AS q, CAST(NULL AS BIGINT) AS det_us FROM {name}_e WHERE i = 1
 UNION ALL SELECT n.clip_id, n.i, n.side, n.t_us, CASE WHEN n.side = 0 THEN list_append(f.q, n.t_us) ELSE list_filter(f.q, lambda x: x >= n.t_us - {tol})[2:] END, CASE WHEN n.side = 1 THEN list_filter(f.q, lambda x: x >= n.t_us - {tol})[1] END
 FROM {name}_f f JOIN {name}_e n ON n.clip_id = f.clip_id AND n.i = f.i + 1),
{name} AS (SELECT clip_id, t_us, det_us FROM {name}_f WHERE side = 1)"""


@query("greedy_match", "SELECT * FROM gm", match_sql("v_truth", "v_pred", TOL, "gm"))
def _(v):
    return E.greedy_match(v.truth(), v.pred(), TOL, v.blocks)


_M03 = 3 * U // 10
_COV = f"""cov AS (SELECT clip_id, min(t_us) + {_M03} AS lo, max(t_us) - {_M03} AS hi FROM v_truth GROUP BY 1),
gti AS (SELECT t.* FROM v_truth t JOIN cov c ON c.clip_id = t.clip_id WHERE t_us > lo AND t_us < hi), dti AS (SELECT t.* FROM v_pred t JOIN cov c ON c.clip_id = t.clip_id WHERE t_us > lo AND t_us < hi)"""
_SC = """bsc AS (SELECT *, coalesce(2 * recall * "precision" / nullif(recall + "precision", 0), 0.0) AS f1 FROM (SELECT *, coalesce(CAST(m AS DOUBLE) / nullif(n_truth, 0), 0.0) AS recall, coalesce(CAST(m AS DOUBLE) / nullif(n_det, 0), 0.0) AS "precision" FROM (
 SELECT c.clip_id, coalesce(m, 0) AS m, coalesce(n_truth, 0) AS n_truth, coalesce(n_det, 0) AS n_det FROM cov c LEFT JOIN (SELECT clip_id, count(det_us) AS m, count(*) AS n_truth FROM gmi GROUP BY 1) g ON g.clip_id = c.clip_id LEFT JOIN (SELECT clip_id, count(*) AS n_det FROM dti GROUP BY 1) d ON d.clip_id = c.clip_id)))"""


@query("boundary_scores", "SELECT * FROM bsc", _COV, match_sql("gti", "dti", TOL, "gmi"), _SC)
def _(v):
    return E.boundary_scores(v.truth(), v.pred(), TOL, _M03, v.blocks)


@query("boundary_scores_mean", 'SELECT count(*) AS clips, round(avg(recall), 9) AS recall, round(avg("precision"), 9) AS "precision", round(avg(f1), 9) AS f1 FROM bsc', _COV, match_sql("gti", "dti", TOL, "gmi"), _SC)
def _(v):
    m = E.macro_mean(E.boundary_scores(v.truth(), v.pred(), TOL, _M03, v.blocks))
    return m.select("clips", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "f1")])


@query(
    "score_boundaries",
    f"""SELECT g.clip_id, m, coalesce(CAST(m AS DOUBLE) / nullif(n, 0), 0.0) AS recall, coalesce(CAST(m AS DOUBLE) / nullif(ni, 0), 0.0) AS "precision" FROM (SELECT clip_id, count(det_us) AS m, count(*) AS n FROM gm GROUP BY 1) g
 JOIN (SELECT p.clip_id, count(*) FILTER (t_us > {_M03} AND t_us < l - {_M03}) AS ni FROM v_pred p JOIN (SELECT clip_id, max(t_us) AS l FROM v_pred GROUP BY 1) x ON x.clip_id = p.clip_id GROUP BY 1) d ON d.clip_id = g.clip_id""",
    match_sql("v_truth", "v_pred", TOL, "gm"),
)
def _(v):
    return E.score_boundaries(v.truth(), v.pred(), TOL, _M03, v.blocks)


@query("determinism", "SELECT clip_id, min(CAST(coalesce(abs(a - b) <= 60000000, false) AS INT)) AS same FROM (SELECT clip_id, t_us AS a, t_us + CASE WHEN clip_id % 4 = 0 THEN 60000000 * (k % 3) ELSE 60000000 END AS b FROM v_obs) GROUP BY 1")
def _(v):
    o = v.obs()
    two = o.select("clip_id", (F.col("t_us") + F.when(F.col("clip_id") % 4 == 0, F.lit(60_000_000) * (F.col("k") % 3)).otherwise(60_000_000)).alias("t_us"))
    return E.determinism(o, two, 60_000_000, v.blocks)


@query("determinism_strict", "SELECT clip_id, min(CAST(coalesce(abs(a - b) < 60000000, false) AS INT)) AS same FROM (SELECT clip_id, t_us AS a, t_us + CASE WHEN clip_id % 4 = 0 THEN 60000000 ELSE 59999999 END AS b FROM v_obs) GROUP BY 1")
def _(v):
    o = v.obs()
    two = o.select("clip_id", (F.col("t_us") + F.when(F.col("clip_id") % 4 == 0, 60_000_000).otherwise(59_999_999)).alias("t_us"))
    return E.determinism(o, two, 60_000_000, v.blocks, strict=True)


# truth: the segments; prediction: six-event segments with the labels of their first event
_AL = """v_six AS (SELECT clip_id, seg // 6 AS seg, min(start_us) AS start_us, max(end_us) AS end_us, arg_min(left_label, seg) AS left_label, arg_min(right_label, seg) AS right_label FROM v_segments GROUP BY 1, 2),
al AS (SELECT g.clip_id, g.seg, (SELECT min(p.seg) FROM v_six p WHERE p.clip_id = g.clip_id AND (g.start_us + g.end_us) // 2 BETWEEN p.start_us - 36000000 AND p.end_us + 36000000) AS pred_seg FROM v_segments g),
slots AS (SELECT g.clip_id, g.seg, g.hand, g.label AS gt, CASE g.hand WHEN 'left' THEN p.left_label ELSE p.right_label END AS pred FROM (SELECT clip_id, seg, 'left' AS hand, left_label AS label FROM v_segments UNION ALL SELECT clip_id, seg, 'right', right_label FROM v_segments) g
 JOIN al ON al.clip_id = g.clip_id AND al.seg = g.seg JOIN v_six p ON p.clip_id = al.clip_id AND p.seg = al.pred_seg WHERE g.label <> 'N/A')"""


def six(v):
    from .track_queries import six as s

    return s(v)


def slots(v):
    t, p = v.segments(), six(v)
    return E.identity_slots(t, p, J.align_by_midpoint(t, p, U // 100, 5 * DAY, v.blocks))


@query("identity_slots", "SELECT * FROM slots", _AL)
def _(v):
    return slots(v)


@query(
    "identity_accuracy",
    "SELECT clip_id, slots, matched, na_misses, CASE WHEN slots = 0 THEN 0.0 ELSE matched / slots END AS acc FROM (SELECT clip_id, count(m) AS slots, count(*) FILTER (m = 1) AS matched, count(*) FILTER (m = 0 AND pred = 'N/A') AS na_misses FROM (SELECT *, CASE WHEN seg % 7 > 0 THEN CAST(gt = pred AS INT) END AS m FROM slots) GROUP BY ROLLUP (clip_id))",
    _AL,
)
def _(v):
    judged = slots(v).withColumn("match", F.when(F.col("seg") % 7 > 0, (F.col("gt") == F.col("pred")).cast("int")))
    return E.identity_accuracy(judged)


@query(
    "grounding_precision",
    """SELECT clip_id, count(*) FILTER (gt <> 'N/A') AS judged, count(*) FILTER (gt <> 'N/A' AND contains(lower(gt), lower(name))) AS "right", count(*) FILTER (gt = 'N/A') AS false_pos FROM (
 SELECT o.clip_id, o.event_type AS name, CASE o.hand WHEN 'left' THEN s.left_label ELSE s.right_label END AS gt FROM (SELECT o.*, unnest(['left', 'right']) AS hand, (SELECT min(seg) FROM v_segments s WHERE s.clip_id = o.clip_id AND o.t_us BETWEEN s.start_us - 50000 AND s.end_us + 50000) AS seg FROM v_obs o WHERE event_type <> 'error') o JOIN v_segments s ON s.clip_id = o.clip_id AND s.seg = o.seg) GROUP BY 1""",
)
def _(v):
    i = v.obs().select("clip_id", "t_us", F.explode(F.array(F.lit("left"), F.lit("right"))).alias("hand"), F.col("event_type").alias("name"), (F.col("event_type") != "error").cast("int").alias("obj"))
    return E.grounding_precision(i, v.segments(), DAY)


@query("tag_overlap", "SELECT DISTINCT 'u' || user_id || '-' AS tag FROM events WHERE event_type = 'error'")
def _(v):
    e = v.table("events")
    pred = e.select(F.concat(F.lit("u"), "user_id", F.lit("-")).alias("tag"))
    truth = e.where("event_type = 'error'").select(F.concat(F.lit("t_u"), "user_id", F.lit("-x.json")).alias("name"))
    return E.tag_overlap(pred, truth)


_GR = f"(g.seg + 1) || '. [' || {SECTXT.format(c='g.start_us')} || '-' || {SECTXT.format(c='g.end_us')} || '] GT: L=' || g.left_label || ' | R=' || g.right_label || '  <=>  PRED: L=' || coalesce(p.left_label, 'N/A') || ' | R=' || coalesce(p.right_label, 'N/A')"


@query("grade_sheet", f"SELECT g.clip_id, g.seg // 1000 AS page, string_agg({_GR}, chr(10) ORDER BY g.seg) AS text FROM v_segments g JOIN al ON al.clip_id = g.clip_id AND al.seg = g.seg LEFT JOIN v_six p ON p.clip_id = al.clip_id AND p.seg = al.pred_seg GROUP BY 1, 2", _AL)
def _(v):
    from ..operators.analysis import text_pages

    t, p = v.segments(), six(v)
    return text_pages(E.grade_rows(t, p, J.align_by_midpoint(t, p, U // 100, 5 * DAY, v.blocks)))
