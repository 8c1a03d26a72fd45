"""Interval, band, as-of and lookup joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..plans.ordered import Ordered
from .registry import query
from .text_queries import HANDS, LABEL_WORDS, hands
from .views import DAY, U

S05, S06, S04, S05H, S08 = U // 20, 6 * U // 10, 4 * U // 10, U // 2, 8 * U // 10
ITV = "v_iv AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY start_us) - 1 AS seg FROM v_track)"


def intervals(v):
    return v.ordered(order=("start_us",)).number(v.track(), "seg")


@query(
    "frames_in_segments",
    f"SELECT f.clip_id, f.frame, s.seg FROM v_frames f JOIN v_iv s ON f.clip_id = s.clip_id AND f.t_us BETWEEN s.start_us - {S05} AND s.end_us + {S05}",
    ITV,
)
def _(v):
    s = intervals(v).select("clip_id", "seg", "start_us", "end_us")
    return J.frames_in_segments(v.frames().select("clip_id", "frame", "t_us"), s, S05, DAY).select("clip_id", "frame", "seg")


@query(
    "span_frames",
    """SELECT f.clip_id, f.frame, s.seg FROM v_iv s JOIN v_frames f ON f.clip_id = s.clip_id
 WHERE f.frame >= (SELECT min(g.frame) FROM v_frames g WHERE g.clip_id = s.clip_id AND g.t_us >= s.start_us)
 AND f.frame <= coalesce((SELECT min(g.frame) FROM v_frames g WHERE g.clip_id = s.clip_id AND g.t_us >= s.end_us), 1000000000)""",
    ITV,
)
def _(v):
    s = intervals(v).select("clip_id", "seg", "start_us", "end_us")
    return J.span_frames(v.frames().select("clip_id", "frame", "t_us"), s, DAY, v.blocks).select("clip_id", "frame", "seg")


_M = U // 10


@query(
    "overlap_join",
    f"""SELECT s.clip_id, s.seg, t.hand, count(*) AS n, CAST(sum(least(t.end_us, s.end_us) - greatest(t.start_us, s.start_us)) AS BIGINT) AS cover_us
 FROM v_segments s JOIN v_track t ON s.clip_id = t.clip_id AND t.end_us > s.start_us + {_M} AND t.start_us < s.end_us - {_M} GROUP BY 1, 2, 3""",
)
def _(v):
    s = v.segments().select("clip_id", "seg", "start_us", "end_us")
    j = J.overlap_join(s, v.track(), ["clip_id"], _M, DAY)
    return j.groupBy("clip_id", "seg", "hand").agg(F.count("*").alias("n"), F.sum("cover_us").alias("cover_us"))


def _near_sql(edge, tol):
    return f"SELECT s.clip_id, s.seg, s.hand, t.object FROM v_hands s JOIN v_track t ON s.clip_id = t.clip_id AND s.hand = t.hand AND s.{edge}_us BETWEEN t.start_us - {tol} AND t.end_us + {tol}"


@query("near_start_intervals", _near_sql("start", S08), HANDS)
def _(v):
    return J.near_edge(hands(v), v.track(), ["clip_id", "hand"], "start", S08, DAY).select("clip_id", "seg", "hand", "object")


@query("near_end_intervals", _near_sql("end", S05H), HANDS)
def _(v):
    return J.near_edge(hands(v), v.track(), ["clip_id", "hand"], "end", S05H, DAY).select("clip_id", "seg", "hand", "object")


@query(
    "unmatched_events",
    f"SELECT e.clip_id, e.t_us, e.kind, e.hand FROM v_transitions e WHERE NOT EXISTS (SELECT 1 FROM v_pred b WHERE b.clip_id = e.clip_id AND abs(e.t_us - b.t_us) <= {U // 120})",
)
def _(v):
    return J.unmatched_events(v.transitions(), v.pred(), U // 120, DAY).select("clip_id", "t_us", "kind", "hand")


@query(
    "owner_segment",
    f"SELECT e.clip_id, e.t_us, coalesce((SELECT min(seg) FROM v_iv s WHERE s.clip_id = e.clip_id AND e.t_us BETWEEN s.start_us - {S05} AND s.end_us + {S05}), 0) AS seg FROM v_pred e",
    ITV,
)
def _(v):
    return J.owner_segment(v.pred(), intervals(v), S05, DAY)


def _edge_sql(col):
    return f"SELECT e.clip_id, e.t_us, (SELECT max(seg) FROM v_iv s WHERE s.clip_id = e.clip_id AND abs(s.{col} - e.t_us) <= {S04}) AS seg FROM v_pred e"


@query("edge_segment_before", _edge_sql("end_us"), ITV)
def _(v):
    return J.edge_segment(v.pred(), intervals(v), "before", S04, DAY)


@query("edge_segment_after", _edge_sql("start_us"), ITV)
def _(v):
    return J.edge_segment(v.pred(), intervals(v), "after", S04, DAY)


@query(
    "protected_boundaries",
    f"SELECT b.clip_id, b.t_us, CAST(EXISTS (SELECT 1 FROM v_transitions e WHERE e.clip_id = b.clip_id AND abs(b.t_us - e.t_us) <= {S05H}) AS INT) AS protected FROM v_pred b",
)
def _(v):
    return J.protected(v.pred(), v.transitions(), S05H, DAY)


# truth spans: between consecutive truth boundaries; predicted spans: the (gappy) track
_TR = """v_ts AS (SELECT * FROM (SELECT clip_id, t_us AS start_us, lead(t_us) OVER w AS end_us, row_number() OVER w - 1 AS seg FROM v_truth WINDOW w AS (PARTITION BY clip_id ORDER BY t_us)) WHERE end_us IS NOT NULL)"""


def _contain_sql(points, slack):
    return f"""SELECT p.clip_id, p.p_id, coalesce(c.seg, (SELECT s.seg FROM v_iv s WHERE s.clip_id = p.clip_id ORDER BY abs(2 * p.t_us - s.start_us - s.end_us), s.start_us + s.end_us, s.seg LIMIT 1)) AS seg,
 CASE WHEN c.seg IS NULL THEN 'nearest' ELSE 'contains' END AS how FROM ({points}) p LEFT JOIN (
 SELECT q.clip_id, q.p_id, min(s.seg) AS seg FROM ({points}) q JOIN v_iv s ON s.clip_id = q.clip_id AND q.t_us BETWEEN s.start_us - {slack} AND s.end_us + {slack} GROUP BY 1, 2) c ON c.clip_id = p.clip_id AND c.p_id = p.p_id"""


@query(
    "align_by_midpoint",
    "SELECT clip_id, p_id AS seg, seg AS pred_seg, how FROM ("
    + _contain_sql("SELECT clip_id, seg AS p_id, (start_us + end_us) // 2 AS t_us FROM v_ts", U // 100)
    + ")",
    ITV,
    _TR,
)
def _(v):
    from ..operators.timeline import spans_from_bounds

    t = v.ordered(order=("start_us",)).number(spans_from_bounds(v.truth(), v.blocks), "seg")
    return J.align_by_midpoint(t, intervals(v), U // 100, DAY, v.blocks)


@query("identity_at_time", _contain_sql("SELECT clip_id, t_us AS p_id, t_us FROM v_pred", 0), ITV)
def _(v):
    p = v.pred().withColumn("p_id", F.col("t_us"))
    return J.contain_or_nearest(p, intervals(v), 0, DAY, v.blocks).select("clip_id", "p_id", "seg", "how")


_NEAR = """SELECT p.clip_id, p.t_us, n.frame, n.d AS distance FROM v_pred p, LATERAL (SELECT f.frame, abs(f.t_us - p.t_us) AS d FROM v_frames f WHERE f.clip_id = p.clip_id ORDER BY d, f.t_us LIMIT 1) n"""


@query("nearest_frame", _NEAR)
def _(v):
    return J.nearest_frame(v.pred(), v.frames(), v.blocks)


@query("nearest_within", f"SELECT clip_id, t_us, CASE WHEN distance <= 60000000 THEN frame END AS frame FROM ({_NEAR})")
def _(v):
    return J.nearest_within(v.pred(), v.frames(), 60_000_000, v.blocks)


for _mode, _lo, _hi in (("slack", -50_000, 50_000), ("closed", 0, 0), ("half_open", 0, 999)):

    @query(
        f"label_at_{_mode}",
        f"SELECT p.clip_id, p.t_us, (SELECT min(seg) FROM v_segments s WHERE s.clip_id = p.clip_id AND p.t_us BETWEEN s.start_us + {_lo} AND s.end_us + {_hi}) AS seg FROM v_pred p",
    )
    def _(v, mode=_mode):
        return J.label_at(v.pred(), v.segments(), mode, DAY)


@query(
    "contact_pairs",
    """SELECT a.event_id AS entity, a.event_id // 3 AS frame, b.event_type AS object
 FROM events a LEFT JOIN events b ON b.event_id = a.event_id + 1 AND b.event_id // 3 = a.event_id // 3""",
)
def _(v):
    e = v.table("events").select(
        F.floor(F.col("event_id") / 3).alias("frame"),
        F.col("event_id").alias("entity"),
        F.col("event_type").alias("name"),
        (F.col("event_id") + 1).alias("in_contact"),
    )
    return J.contact_pairs(e).select("entity", "frame", "object")


@query(
    "overlay_labels",
    "SELECT s.clip_id, s.seg, coalesce(o.event_type, s.left_label) AS label, CAST(o.event_type IS NULL AS INT) AS fallback FROM v_segments s LEFT JOIN (SELECT clip_id, seg, event_type FROM v_segments WHERE event_type IN ('click','view')) o ON o.clip_id = s.clip_id AND o.seg = s.seg",
)
def _(v):
    s = v.segments()
    over = s.where(F.col("event_type").isin("click", "view")).withColumnRenamed("event_type", "name")
    return J.overlay_labels(s.withColumnRenamed("left_label", "label"), over, ["clip_id", "seg"])


@query(
    "needs_review",
    "SELECT clip_id, seg, CAST(event_type = 'error' OR left_label = 'N/A' OR end_us - start_us > 20 * 3600000000 AS INT) AS needs_review FROM v_segments",
)
def _(v):
    s = v.segments()
    flags = s.where("event_type = 'error' OR left_label = 'N/A'")
    qa = s.where(F.col("end_us") - F.col("start_us") > 20 * U)
    return J.needs_review(s, flags, qa).select("clip_id", "seg", "needs_review")


@query(
    "pair_by_tag",
    """SELECT tag, min(name) AS name FROM (SELECT DISTINCT 'u' || clip_id || '-' AS tag FROM v_obs) t
 JOIN (SELECT DISTINCT 'truth_u' || user_id || '-' || event_type || '.json' AS name FROM events) n ON contains(n.name, t.tag) GROUP BY tag""",
)
def _(v):
    pred = v.obs().select(F.concat(F.lit("u"), "clip_id", F.lit("-")).alias("tag"))
    truth = v.table("events").select(F.concat(F.lit("truth_u"), "user_id", F.lit("-"), "event_type", F.lit(".json")).alias("name"))
    return J.pair_by_tag(pred, truth)


_OV = "v_ov AS (SELECT DISTINCT clip_id FROM v_obs WHERE event_type = 'error' AND k >= 95)"


@query(
    "apply_overrides",
    """SELECT clip_id, start_us, left_label, 0 AS override_applied FROM v_segments WHERE clip_id NOT IN (SELECT clip_id FROM v_ov)
 UNION ALL SELECT clip_id, start_us, object, 1 FROM v_track WHERE clip_id IN (SELECT clip_id FROM v_ov)""",
    _OV,
)
def _(v):
    clips = v.obs().where("event_type = 'error' AND k >= 95").select("clip_id").distinct()
    ov = v.track().join(clips, "clip_id", "left_semi").select("clip_id", "start_us", F.col("object").alias("left_label"))
    return J.apply_overrides(v.segments().select("clip_id", "start_us", "left_label"), ov)


@query("override_originals", "SELECT clip_id, start_us, left_label FROM v_segments WHERE clip_id IN (SELECT clip_id FROM v_ov)", _OV)
def _(v):
    clips = v.obs().where("event_type = 'error' AND k >= 95").select("clip_id").distinct()
    return J.override_originals(v.segments().select("clip_id", "start_us", "left_label"), clips)


_CAT = "v_cat AS (SELECT DISTINCT clip_id, event_type AS name, CASE WHEN k < 50 THEN 'take' ELSE 'hold' END AS colour FROM v_obs WHERE event_type IN ('click','view'))"


@query(
    "oov_words",
    f"""SELECT DISTINCT clip_id, word FROM (SELECT clip_id, unnest({LABEL_WORDS.format(c='label')}) AS word FROM v_hands) w
 WHERE length(word) > 2 AND NOT regexp_full_match(word, '[0-9]+') AND NOT EXISTS (SELECT 1 FROM v_cat c WHERE c.clip_id = w.clip_id AND (c.name = w.word OR c.colour = w.word))""",
    HANDS,
    _CAT,
)
def _(v):
    cat = (
        v.obs()
        .where(F.col("event_type").isin("click", "view"))
        .select("clip_id", F.col("event_type").alias("name"), F.when(F.col("k") < 50, "take").otherwise("hold").alias("colour"))
        .distinct()
    )
    return J.oov_words(hands(v), cat)


_VOC = """v_voc AS (SELECT clip_id, name, row_number() OVER (PARTITION BY clip_id ORDER BY name) AS ord FROM (SELECT DISTINCT clip_id, concat(upper(left_touching[1]), left_touching[2:], ' part') AS name FROM v_obs WHERE event_type IN ('click','signup') UNION SELECT DISTINCT clip_id, 'view' FROM v_obs)),
v_free AS (SELECT clip_id, t_us, CASE WHEN k % 3 = 0 THEN left_touching WHEN k % 3 = 1 THEN upper(right_touching) ELSE right_touching || ' with bolts' END AS name FROM v_obs),
v_varr AS (SELECT clip_id, list(name ORDER BY ord) AS vv FROM v_voc GROUP BY clip_id)"""


@query(
    "snap_vocab",
    """SELECT f.clip_id, f.t_us, CASE WHEN len(list_filter(vv, lambda x: lower(x) = lower(name))) > 0 THEN list_filter(vv, lambda x: lower(x) = lower(name))[-1]
 WHEN len(list_filter(vv, lambda x: contains(lower(name), lower(x)))) > 0 THEN name
 ELSE coalesce(list_filter(vv, lambda x: contains(lower(x), lower(name)))[1], 'N/A') END AS snapped FROM v_free f JOIN v_varr a ON a.clip_id = f.clip_id""",
    _VOC,
)
def _(v):
    o = v.obs()
    known = (
        o.where(F.col("event_type").isin("click", "signup"))
        .select("clip_id", F.concat(F.initcap("left_touching"), F.lit(" part")).alias("name"))
        .union(o.select("clip_id", F.lit("view")))
        .distinct()
    )
    voc = Ordered(["clip_id"], ["name"]).number(known, "ord")  # a handful of distinct names per clip
    free = o.select(
        "clip_id",
        "t_us",
        F.when(F.col("k") % 3 == 0, F.col("left_touching"))
        .when(F.col("k") % 3 == 1, F.upper("right_touching"))
        .otherwise(F.concat("right_touching", F.lit(" with bolts")))
        .alias("name"),
    )
    return J.snap_vocab(free, voc).select("clip_id", "t_us", "snapped")


@query(
    "other_hand",
    """SELECT clip_id, t_us, hand, CASE WHEN hand = 'left' THEN k + 1 ELSE k END AS other_x, CASE WHEN hand = 'left' THEN 2 * k + 1 ELSE 2 * k END AS other_y
 FROM (SELECT *, unnest(CASE WHEN event_type = 'view' THEN ['left'] ELSE ['left', 'right'] END) AS hand FROM v_obs) WHERE event_type <> 'view'
 UNION ALL SELECT clip_id, t_us, 'left', NULL, NULL FROM v_obs WHERE event_type = 'view'""",
)
def _(v):
    both = F.when(F.col("event_type") == "view", F.array(F.lit("left"))).otherwise(F.array(F.lit("left"), F.lit("right")))
    p = v.obs().select("clip_id", "t_us", "k", F.explode(both).alias("hand"))
    right = (F.col("hand") == "right").cast("int")
    p = p.select("clip_id", "t_us", "hand", (F.col("k") + right).alias("x"), (2 * F.col("k") + right).alias("y"))
    return J.other_hand(p).select("clip_id", "t_us", "hand", "other_x", "other_y")


@query(
    "segment_identity",
    """SELECT clip_id, num, seg_start, l.n AS left_name, r.n AS right_name FROM (SELECT clip_id, 's' || (seg // 2) AS num, min(start_us) AS seg_start,
 arg_max({'n': CASE WHEN event_type <> 'error' THEN event_type END}, start_us) FILTER (WHERE k % 2 = 0) AS l,
 arg_max({'n': CASE WHEN event_type <> 'error' THEN event_type END}, start_us) FILTER (WHERE k % 2 = 1) AS r
 FROM v_segments GROUP BY clip_id, seg // 2)""",
)
def _(v):
    s = v.segments().withColumn(
        "seg_id",
        F.concat(F.lit("s"), F.floor(F.col("seg") / 2).cast("string"), F.when(F.col("k") % 2 == 0, "L").otherwise("R")),
    )
    p = s.select("clip_id", "seg_id", F.col("start_us").alias("seg_start"), F.lit(1).alias("primary"))
    i = s.select("clip_id", "seg_id", F.col("start_us").alias("t_us"), (F.col("event_type") != "error").cast("int").alias("obj"), F.col("event_type").alias("name"))
    return J.segment_identity(p, i)
