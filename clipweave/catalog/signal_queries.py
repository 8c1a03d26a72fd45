"""Hand signals, measured spans and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import joins as J
from ..operators import signal as S
from ..plans.cut import cut
from ..plans.ranges import levels_in_use
from .registry import query
from .text_queries import HANDS, UNS, SCR, hands
from .timeline_queries import DIRECTION_CTES, SUMMARY, runs_sql, summary, thin_sql
from .views import DAY, U

SIG = """v_sig AS (SELECT clip_id, t_us, frame, k, event_id, 'left' AS hand, signal AS x, CAST(k * 100 AS BIGINT) AS y, CASE WHEN event_id % 13 <> 0 THEN CAST(k * 10 AS BIGINT) END AS grip FROM v_frames
 UNION ALL SELECT clip_id, t_us, frame, k, event_id, 'right', CASE WHEN event_id % 11 <> 0 THEN CAST(k * 70 AS BIGINT) END, signal, CASE WHEN event_id % 17 <> 0 THEN CAST(1000 - k * 10 AS BIGINT) END FROM v_frames)"""


def signals(v, frames=None):
    f = v.obs() if frames is None else frames
    k = F.col("k").cast("long")
    row = lambda h, x, y, g: F.struct(F.lit(h).alias("hand"), x.alias("x"), y.alias("y"), g.alias("grip"))
    ok = lambda n, c: F.when(F.col("event_id") % n != 0, c)
    keep = [c for c in ("clip_id", "t_us", "frame", "k", "event_id") if c in f.columns]
    return f.select(
        *keep,
        F.inline(F.array(row("left", F.col("signal"), k * 100, ok(13, k * 10)), row("right", ok(11, k * 70), F.col("signal"), ok(17, 1000 - k * 10)))),
    )


def smooth_sql(src, cols, half, name, key="clip_id, hand"):
    w = f"(PARTITION BY {key} ORDER BY t_us ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    return f"{name} AS (SELECT *, " + ", ".join(f"CAST(sum({c}) OVER {w} AS DOUBLE) / nullif(count({c}) OVER {w}, 0) AS {c}_smooth" for c in cols) + f" FROM {src})"


def grad_sql(src, cols, name):
    e = ", ".join(
        f"CASE WHEN row_number() OVER w = 1 THEN lead({c}) OVER w - {c} WHEN lead(1) OVER w IS NULL THEN {c} - lag({c}) OVER w ELSE (lead({c}) OVER w - lag({c}) OVER w) / 2 END AS {c}_grad"
        for c in cols
    )
    return f"{name} AS (SELECT *, {e} FROM {src} WINDOW w AS (PARTITION BY clip_id, hand ORDER BY t_us))"


ENERGY = (
    SIG,
    smooth_sql("v_sig", ["x", "y"], 2, "s1"),
    grad_sql("s1", ["x_smooth", "y_smooth"], "s2"),
    "s3 AS (SELECT clip_id, hand, t_us, frame, CAST(floor(sqrt(x_smooth_grad * x_smooth_grad + y_smooth_grad * y_smooth_grad) * 1.0 + 0.5) AS BIGINT) AS speed FROM s2)",
    smooth_sql("s3", ["speed"], 1, "s4"),
    "spd AS (SELECT clip_id, hand, t_us, frame, CAST(floor(speed_smooth + 0.5) AS BIGINT) AS speed FROM s4)",
    "en AS (SELECT clip_id, t_us, frame, max(speed) AS energy FROM spd GROUP BY 1, 2, 3)",
)
THR = (
    "q1 AS (SELECT clip_id, quantile_cont(coalesce(energy,0), 0.5) AS med, quantile_cont(coalesce(energy,0), 0.75) AS p75 FROM en GROUP BY 1)",
    "th AS (SELECT clip_id, greatest(any_value(med) + 3 * (quantile_cont(CAST(abs(coalesce(energy,0) * 2 - med * 2) AS BIGINT), 0.5) / 2 + 1), any_value(p75)) AS thr FROM en JOIN q1 USING (clip_id) GROUP BY 1)",
)


def speed(v):
    return S.hand_speed(signals(v), 1.0, v.blocks)


def energy(v):
    return S.motion_energy(speed(v))


def shared_energy(v):
    """Energy that several branches read: written once."""
    return cut(energy(v))


def measured(v):
    """(speed, energy, threshold) that spans and facts read: written once."""
    sp = cut(speed(v))
    e = cut(S.motion_energy(sp))
    return sp, e, cut(S.adaptive_threshold(e, v.blocks))


@query("smooth_signal", "SELECT clip_id, hand, t_us, x_smooth, y_smooth FROM s1", *ENERGY[:2])
def _(v):
    return S.smooth(signals(v), ["x", "y"], 2, v.ordered(("clip_id", "hand"))).select("clip_id", "hand", "t_us", "x_smooth", "y_smooth")


@query("signal_gradient", "SELECT clip_id, hand, t_us, x_grad FROM g0", SIG, grad_sql("v_sig", ["x"], "g0"))
def _(v):
    return S.gradient(signals(v).withColumn("x", F.col("x").cast("double")), ["x"], v.ordered(("clip_id", "hand"))).select("clip_id", "hand", "t_us", "x_grad")


@query("motion_energy", "SELECT clip_id, t_us, energy FROM en", *ENERGY)
def _(v):
    return energy(v)


@query("adaptive_threshold", "SELECT * FROM th", *ENERGY, *THR)
def _(v):
    return S.adaptive_threshold(shared_energy(v), v.blocks)


GAP, MINB = 20 * U, 6 * U
# the clip scale is hours, with about eleven between frames: bursts merge at 20 h and last at least 6 h
_HOTF = "hf AS (SELECT e.clip_id, e.t_us, coalesce(energy,0) > thr AS hot FROM en e JOIN th USING (clip_id))"
HOT = (_HOTF, runs_sql("hf", "clip_id", "t_us", ["hot"], "hr"), "hot AS (SELECT clip_id, min(t_us) AS start_us, max(t_us) AS end_us FROM hr WHERE hot GROUP BY clip_id, run)")
MERGED = (
    f"hm AS (SELECT *, sum(b) OVER (PARTITION BY clip_id ORDER BY start_us) AS g FROM (SELECT *, CASE WHEN start_us - lag(end_us) OVER w <= {GAP} THEN 0 ELSE 1 END AS b FROM hot WINDOW w AS (PARTITION BY clip_id ORDER BY start_us)))",
    f"mb AS (SELECT * FROM (SELECT clip_id, min(start_us) AS start_us, max(end_us) AS end_us FROM hm GROUP BY clip_id, g) WHERE end_us - start_us >= {MINB})",
)
_MS = 12 * U
SPLIT = (
    "ep AS (SELECT clip_id, t_us, frame, coalesce(energy,0) AS e, coalesce(lag(t_us) OVER (PARTITION BY clip_id ORDER BY t_us), -1) AS pt FROM en)",
    f"ins AS (SELECT b.clip_id, b.start_us, b.end_us, t_us, e FROM mb b JOIN ep ON ep.clip_id = b.clip_id AND t_us >= start_us AND pt < end_us WHERE b.end_us - b.start_us >= {2 * _MS})",
    "dip AS (SELECT *, d.t AS tk, d.e AS ek FROM (SELECT clip_id, start_us, end_us, count(*) AS n, min({'e': e, 't': t_us}) AS d FROM ins GROUP BY 1,2,3))",
    f"""cutx AS (SELECT d.clip_id, d.start_us, d.end_us, tk FROM dip d JOIN ins i USING (clip_id, start_us, end_us) WHERE n >= 5 AND tk - start_us >= {_MS} AND end_us - tk >= {_MS}
 GROUP BY 1,2,3,4,ek HAVING ek * 100 < least(coalesce(max(i.e) FILTER (i.t_us < tk), 0), coalesce(max(i.e) FILTER (i.t_us > tk), 0)) * 55)""",
    """sb AS (SELECT m.clip_id, m.start_us, coalesce(tk, m.end_us) AS end_us FROM mb m LEFT JOIN cutx c USING (clip_id, start_us, end_us)
 UNION ALL SELECT clip_id, tk, end_us FROM cutx)""",
)
_MA, _TL = 15 * U, 2 * U
TILE = (
    "tb AS (SELECT b.*, coalesce(lag(end_us) OVER w, 0) AS cur, lead(1) OVER w IS NULL AS lst, dur_us FROM sb b JOIN v_clips USING (clip_id) WINDOW w AS (PARTITION BY clip_id ORDER BY start_us))",
    f"""tl AS (SELECT clip_id, cur AS start_us, start_us AS end_us, 'action' AS type FROM tb WHERE start_us - cur >= {_MA}
 UNION ALL SELECT clip_id, CASE WHEN start_us - cur >= {_MA} THEN start_us ELSE cur END, CASE WHEN lst AND dur_us - end_us < {_TL} THEN dur_us ELSE end_us END, 'transition' FROM tb
 UNION ALL SELECT clip_id, end_us, dur_us, 'action' FROM tb WHERE lst AND dur_us - end_us >= {_TL}
 UNION ALL SELECT clip_id, 0, dur_us, 'action' FROM v_clips WHERE clip_id NOT IN (SELECT clip_id FROM sb))""",
    "spans AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY start_us) - 1 AS seg FROM tl)",
)
SPANS = (*ENERGY, *THR, *HOT, *MERGED, *SPLIT, *TILE)


def hot(v, e, thr=None):
    return S.hot_runs(e, S.adaptive_threshold(e, v.blocks) if thr is None else thr, v.blocks)


def merged(v, e, thr=None):
    return S.merge_bursts(hot(v, e, thr), GAP, MINB, v.blocks)


def spans(v, e=None, thr=None):
    e = shared_energy(v) if e is None else e
    b = cut(S.split_bursts(cut(merged(v, e, thr)), e, _MS, 5 * DAY, v.blocks))
    t = S.tile_spans(b, v.clips(), _MA, _TL, v.blocks)
    return cut(v.ordered(order=("start_us",)).number(t, "seg"))


@query("hot_runs", "SELECT * FROM hot", *ENERGY, *THR, *HOT)
def _(v):
    return hot(v, shared_energy(v))


@query("merge_bursts", "SELECT * FROM mb", *ENERGY, *THR, *HOT, *MERGED)
def _(v):
    return merged(v, shared_energy(v))


@query("split_bursts", "SELECT * FROM sb", *ENERGY, *THR, *HOT, *MERGED, *SPLIT)
def _(v):
    e = shared_energy(v)
    return S.split_bursts(cut(merged(v, e)), e, _MS, 5 * DAY, v.blocks)


@query("tile_spans", "SELECT clip_id, seg, start_us, end_us, type FROM spans", *SPANS)
def _(v):
    return spans(v)


@query("densest_window", f"SELECT clip_id, n, rows FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY rows DESC, n) AS r FROM (SELECT clip_id, t_us AS n, count(*) OVER (PARTITION BY clip_id ORDER BY t_us RANGE BETWEEN CURRENT ROW AND {2 * DAY} FOLLOWING) AS rows FROM v_obs)) WHERE r = 1")
def _(v):
    return S.densest_window(v.obs().select("clip_id", F.col("t_us").alias("n")), 2 * DAY, v.blocks)


_INS = "fin AS (SELECT s.clip_id, s.seg, s.type, s.start_us, s.end_us, g.hand, g.t_us, g.x, g.grip, p.speed FROM spans s JOIN ep f ON f.clip_id = s.clip_id AND f.t_us >= s.start_us AND f.pt < s.end_us JOIN v_sig g ON g.clip_id = f.clip_id AND g.t_us = f.t_us JOIN spd p ON p.clip_id = g.clip_id AND p.hand = g.hand AND p.t_us = g.t_us)"
_EDGE = """edg AS (SELECT clip_id, seg, hand, median(grip) FILTER (r0 <= 3) AS g0, median(grip) FILTER (r1 <= 3) AS g1 FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, seg, hand ORDER BY t_us) AS r0,
 row_number() OVER (PARTITION BY clip_id, seg, hand ORDER BY t_us DESC) AS r1 FROM fin WHERE grip IS NOT NULL) GROUP BY 1,2,3)"""
_MAXT = 40 * U
_FACT = f"""fa AS (SELECT clip_id, seg, hand, any_value(type) AS type, any_value(start_us) AS start_us, any_value(end_us) AS end_us, CAST(floor(coalesce(CAST(sum(speed) AS DOUBLE) / nullif(count(speed), 0), 0.0) + 0.5) AS BIGINT) AS mean_speed,
 CAST(sum(grip) AS DOUBLE) / nullif(count(grip), 0) AS gripr, CAST(count(x) AS DOUBLE) / count(*) AS pres FROM fin GROUP BY 1,2,3),
facts AS (SELECT a.clip_id, a.seg, a.hand, a.type, CASE WHEN a.mean_speed > thr THEN 'moved a lot' WHEN a.mean_speed * 10 > thr * 4 THEN 'moved a little' ELSE 'stayed still' END AS motion,
 CASE WHEN NOT (a.type = 'transition' AND a.end_us - a.start_us <= {_MAXT}) THEN 'grip steady (held)' WHEN g0 IS NULL OR g1 IS NULL THEN 'grip unknown' WHEN g1 - g0 > 100 THEN 'fingers OPENED (likely released/placed)'
 WHEN g0 - g1 > 100 THEN 'fingers CLOSED (grasped/picked up)' ELSE 'grip steady (held)' END AS grip, a.mean_speed, a.gripr, a.pres,
 CASE WHEN a.mean_speed * 10 > coalesce(o.mean_speed, 0) * 14 THEN a.hand WHEN coalesce(o.mean_speed, 0) * 10 > a.mean_speed * 14 THEN o.hand ELSE 'both' END AS acting
 FROM fa a LEFT JOIN fa o ON o.clip_id = a.clip_id AND o.seg = a.seg AND o.hand <> a.hand LEFT JOIN edg e ON e.clip_id = a.clip_id AND e.seg = a.seg AND e.hand = a.hand JOIN th ON th.clip_id = a.clip_id)"""
FACTS = (*SPANS, _INS, _EDGE, _FACT)


def facts(v, m=None, s=None, times=1):
    sp, e, thr = measured(v) if m is None else m
    s = spans(v, e, thr) if s is None else s
    return S.segment_facts(signals(v), sp, s, thr.withColumn("thr", F.col("thr") * times), _MAXT, 5 * DAY, v.blocks, J.span_levels(s, 5 * DAY))


def facts_and_rotation(v):
    """Both over the same spans, from speeds that are worked out once."""
    m = measured(v)
    s = spans(v, *m[1:])
    return facts(v, m, s), rotation(v, s)


@query("edge_median_grip", "SELECT * FROM edg WHERE g0 IS NOT NULL", *SPANS, _INS, _EDGE)
def _(v):
    return S.edge_median(signals(v), spans(v), 3, 5 * DAY, v.blocks)


@query("segment_facts", "SELECT * FROM facts", *FACTS)
def _(v):
    return facts(v)


# rotation: per-frame samples from the signals; curl is signed
_ROTS = """rsam AS (SELECT clip_id, t_us, hand, CASE WHEN hand = 'left' THEN k * 10 - 480 ELSE 500 - k * 11 END AS curl FROM v_sig),
rot0 AS (SELECT s.clip_id, s.seg, r.hand, CAST(sum(curl) AS DOUBLE) / count(curl) AS curl, CAST(sum(abs(curl)) AS DOUBLE) / count(curl) AS mag FROM spans s JOIN rsam r ON r.clip_id = s.clip_id AND r.t_us BETWEEN s.start_us AND s.end_us GROUP BY 1,2,3)"""


def rotation_by_span(v, s=None):
    s = spans(v) if s is None else s
    return S.segment_rotation(rotation_samples(v), s, 5 * DAY, levels_in_use(s, F.col("start_us"), F.col("end_us"), 5 * DAY))


def rotation_samples(v):
    s = signals(v)
    k = F.col("k").cast("long")
    return s.select("clip_id", "t_us", "hand", F.when(F.col("hand") == "left", k * 10 - 480).otherwise(500 - k * 11).alias("curl"))


@query("segment_rotation", "SELECT * FROM rot0", *SPANS, _ROTS)
def _(v):
    return rotation_by_span(v)


_RW = """rw AS (SELECT clip_id, seg, max(curl) FILTER (hand='left') AS l_curl, max(curl) FILTER (hand='right') AS r_curl, max(mag) FILTER (hand='left') AS l_mag, max(mag) FILTER (hand='right') AS r_mag FROM rot0 GROUP BY 1,2),
ra AS (SELECT *, greatest(l_mag, r_mag) AS e FROM rw), rb AS (SELECT clip_id, quantile_cont(e, 0.5) AS m FROM ra WHERE e > 1e-6 GROUP BY 1),
rc AS (SELECT ra.*, coalesce(e >= greatest(m / 2, 300.0), false) AS f FROM ra LEFT JOIN rb USING (clip_id)),
rd0 AS (SELECT *, CASE WHEN f THEN CASE WHEN l_mag >= r_mag THEN 'left' ELSE 'right' END END AS turner, CASE WHEN f THEN CASE WHEN l_mag >= r_mag THEN l_curl ELSE r_curl END END AS c FROM rc),
rdm AS (SELECT clip_id, CASE WHEN sum(CASE WHEN c >= 0 THEN 1 ELSE -1 END) >= 0 THEN 1 ELSE -1 END AS dom, quantile_cont(abs(c), 0.75) AS strong FROM rd0 WHERE f GROUP BY 1),
rot AS (SELECT r.clip_id, r.seg, CAST(f AS INT) AS fastening, turner, CASE WHEN f THEN CASE WHEN coalesce(CASE WHEN c >= 0 THEN 1 ELSE -1 END <> dom AND abs(c) >= strong, false) THEN CASE WHEN starts_with(majority, 'dis') THEN 'screw' ELSE 'unscrew' END
 ELSE CASE WHEN starts_with(majority, 'dis') THEN 'unscrew' ELSE 'screw' END END END AS direction FROM rd0 r LEFT JOIN rdm USING (clip_id) LEFT JOIN dsum d ON d.clip_id = r.clip_id)"""
ROT = (*SPANS, _ROTS, *DIRECTION_CTES, SUMMARY, _RW)


def rotation(v, s=None):
    r = rotation_by_span(v, s)
    one = lambda h, c: F.max(F.when(F.col("hand") == h, F.col(c)))
    w = cut(r.groupBy("clip_id", "seg").agg(one("left", "curl").alias("l_curl"), one("right", "curl").alias("r_curl"), one("left", "mag").alias("l_mag"), one("right", "mag").alias("r_mag")))
    return S.calibrate(w, summary(v).select("clip_id", F.col("majority").alias("direction")), 300.0, v.blocks)


@query("calibrate_rotation", "SELECT * FROM rot", *ROT)
def _(v):
    return rotation(v)


_IDLE = """idle AS (SELECT clip_id, seg FROM (SELECT f.clip_id, f.seg, CASE WHEN pres < 0.5 THEN true WHEN coalesce(fastening = 1 AND turner = f.hand, false) THEN false ELSE coalesce(motion = 'stayed still' AND gripr >= 400, false) END AS i
 FROM facts f LEFT JOIN rot r ON r.clip_id = f.clip_id AND r.seg = f.seg) GROUP BY 1,2 HAVING bool_and(i))"""
_FR = (*FACTS, _ROTS, *DIRECTION_CTES, SUMMARY, _RW)
_CLS = """CASE WHEN type = 'transition' AND (acting = 'both' OR acting = f.hand) AND contains(grip, 'CLOSED') THEN 'PICK' WHEN type = 'transition' AND (acting = 'both' OR acting = f.hand) AND contains(grip, 'OPENED') THEN 'PLACE'
 WHEN motion = 'moved a lot' THEN 'MOVE' WHEN contains(grip, 'held') OR contains(grip, 'OPENED') OR contains(grip, 'CLOSED') THEN 'FINE' ELSE 'NA' END"""


@query("idle_segments", "SELECT * FROM idle", *_FR, _IDLE)
def _(v):
    return S.idle_segments(*facts_and_rotation(v))


@query("action_classes", f"SELECT f.clip_id, f.seg, f.hand, {_CLS} AS cls FROM facts f", *FACTS)
def _(v):
    return facts(v).select("clip_id", "seg", "hand", S.action_class().alias("cls"))


# labels of the measured spans: those of the segment with the same number
_VIOL = f"""viol AS (SELECT clip_id, seg, hand, reason FROM (SELECT h.clip_id, h.seg, h.hand, CASE WHEN fastening = 1 AND r.direction IS NOT NULL AND label <> 'N/A' AND ({UNS.format(c='label')} OR {SCR.format(c='label')})
 AND NOT CASE WHEN r.direction = 'unscrew' THEN {UNS.format(c='label')} AND NOT {SCR.format(c='label')} ELSE {SCR.format(c='label')} AND NOT {UNS.format(c='label')} END THEN 'wrong rotation, use ' || r.direction
 WHEN {_CLS} IN ('PICK','PLACE') AND label = 'N/A' THEN 'measured ' || {_CLS} || ' but labelled N/A' WHEN {_CLS} = 'MOVE' AND label <> 'N/A' AND regexp_matches(label, '(?i)\\b(hold|holds|holding|steady|steadies|steadying|keep\\w*)\\b') THEN 'measured motion but labelled as holding' END AS reason
 FROM v_hands h JOIN facts f ON f.clip_id = h.clip_id AND f.seg = h.seg AND f.hand = h.hand LEFT JOIN rot r ON r.clip_id = h.clip_id AND r.seg = h.seg) WHERE reason IS NOT NULL)"""


def violations(v, f, r):
    return S.contract_violations(hands(v).select("clip_id", "seg", "hand", "label"), f, r)


@query("contract_violations", "SELECT * FROM viol", HANDS, *_FR, _VIOL)
def _(v):
    return violations(v, *facts_and_rotation(v))


@query("relabel_set", "SELECT DISTINCT clip_id, seg FROM viol v WHERE NOT EXISTS (SELECT 1 FROM idle i WHERE i.clip_id = v.clip_id AND i.seg = v.seg)", HANDS, *_FR, _IDLE, _VIOL)
def _(v):
    f, r = map(cut, facts_and_rotation(v))
    return S.relabel_set(violations(v, f, r), S.idle_segments(f, r))


@query("motion_crosscheck", "SELECT h.clip_id, h.seg, h.hand, 'label_vs_motion?' AS type_ FROM v_hands h JOIN facts f ON f.clip_id = h.clip_id AND f.seg = h.seg AND f.hand = h.hand WHERE f.type = 'transition' AND motion = 'stayed still' AND contains(grip, 'steady') AND label <> 'N/A' AND acting <> h.hand", HANDS, *SPANS, _INS, _EDGE, _FACT.replace("JOIN th ON", "JOIN (SELECT clip_id, thr * 5 AS thr FROM th) th ON"))
def _(v):
    return S.motion_crosscheck(hands(v), facts(v, times=5))


_PTS = """rkp AS (SELECT clip_id, hand, frame, t_us, x, y, grip, CASE WHEN event_id % 7 <> 3 THEN x + k % 9 END AS tx, y + k % 5 AS ty, x + k % 4 AS ix, y - k % 6 AS iy FROM (SELECT clip_id, hand, frame, t_us, event_id, k, CASE WHEN k < 90 THEN k % 30 ELSE k END AS x, CAST(k % 20 AS BIGINT) AS y, grip // 10 AS grip FROM v_sig))"""


@query(
    "robust_frames",
    """SELECT p.clip_id, p.hand, p.frame, coalesce((SELECT arg_min(c.f, {'d': abs(c.f - p.frame), 'f': c.f}) FROM (SELECT w.frame AS f FROM rkp w, rmed m WHERE m.clip_id = p.clip_id AND m.hand = p.hand AND m.frame = p.frame
 AND w.clip_id = p.clip_id AND w.hand = p.hand AND w.frame BETWEEN p.frame - 3 AND p.frame + 3 AND w.x IS NOT NULL AND w.tx IS NOT NULL AND w.ty IS NOT NULL AND w.ix IS NOT NULL AND w.iy IS NOT NULL
 AND (w.x - m.x) * (w.x - m.x) + (w.y - m.y) * (w.y - m.y) <= 400 AND NOT coalesce(w.grip > m.grip + 30, false) AND (w.tx - m.tx) * (w.tx - m.tx) + (w.ty - m.ty) * (w.ty - m.ty) <= 196 AND (w.ix - m.ix) * (w.ix - m.ix) + (w.iy - m.iy) * (w.iy - m.iy) <= 196) c), p.frame) AS use_frame FROM rkp p""",
    SIG,
    _PTS,
    """rmed AS (SELECT p.clip_id, p.hand, p.frame, median(w.x) AS x, median(w.y) AS y, median(w.grip) AS grip, median(w.tx) FILTER (w.tx IS NOT NULL AND w.ty IS NOT NULL AND w.ix IS NOT NULL AND w.iy IS NOT NULL) AS tx,
 median(w.ty) FILTER (w.tx IS NOT NULL) AS ty, median(w.ix) FILTER (w.tx IS NOT NULL) AS ix, median(w.iy) FILTER (w.tx IS NOT NULL) AS iy FROM rkp p JOIN rkp w ON w.clip_id = p.clip_id AND w.hand = p.hand AND w.frame BETWEEN p.frame - 3 AND p.frame + 3 AND w.x IS NOT NULL GROUP BY 1,2,3)""",
)
def _(v):
    k = F.col("k").cast("long")
    x = F.when(F.col("k") < 90, k % 30).otherwise(k)
    s = signals(v, v.frames()).select("clip_id", "hand", "frame", "t_us", "event_id", "k", x.alias("x"), (k % 20).alias("y"), F.floor(F.col("grip") / 10).cast("long").alias("grip"))
    s = s.select("*", F.when(F.col("event_id") % 7 != 3, F.col("x") + k % 9).alias("tx"), (F.col("y") + k % 5).alias("ty"), (F.col("x") + k % 4).alias("ix"), (F.col("y") - k % 6).alias("iy"))
    return S.robust_frame(s, 3, 20, 30, 14, v.blocks)


@query("top_spans", "SELECT clip_id, seg, rank FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY end_us - start_us DESC, start_us) AS rank FROM v_segments) WHERE rank <= 8")
def _(v):
    return S.top_spans(v.segments(), 8).select("clip_id", "seg", "rank")


_BOX = "bx AS (SELECT clip_id, t_us, hand, k * 4 AS x0, k * 3 AS y0, CASE WHEN event_id % 7 <> 0 THEN k * 4 + 100 + k END AS x1, k * 3 + 80 AS y1 FROM v_sig)"


@query(
    "grasp_boxes",
    """SELECT clip_id, seg, greatest(0.0, CASE WHEN bx1 - bx0 < 300 THEN (bx0 + bx1) / 2 - 150 ELSE bx0 END) AS x0, greatest(0.0, CASE WHEN by1 - by0 < 300 THEN (by0 + by1) / 2 - 150 ELSE by0 END) AS y0,
 least(1000.0, CASE WHEN bx1 - bx0 < 300 THEN (bx0 + bx1) / 2 + 150 ELSE bx1 END) AS x1, least(1000.0, CASE WHEN by1 - by0 < 300 THEN (by0 + by1) / 2 + 150 ELSE by1 END) AS y1 FROM (
 SELECT clip_id, seg, x0 - (x1 - x0) / 2 AS bx0, x1 + (x1 - x0) / 2 AS bx1, y0 - (y1 - y0) / 2 AS by0, y1 + (y1 - y0) / 2 AS by1 FROM (
 SELECT s.clip_id, s.seg, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM v_segments s JOIN (SELECT *, coalesce(lag(t_us) OVER (PARTITION BY clip_id, hand ORDER BY t_us), -1) AS pt FROM bx) b
 ON b.clip_id = s.clip_id AND b.t_us >= s.start_us AND b.pt < s.end_us WHERE x1 IS NOT NULL GROUP BY 1, 2))""",
    SIG,
    _BOX,
)
def _(v):
    k = F.col("k").cast("long")
    b = signals(v).select("clip_id", "t_us", "hand", (k * 4).alias("x0"), (k * 3).alias("y0"), F.when(F.col("event_id") % 7 != 0, k * 5 + 100).alias("x1"), (k * 3 + 80).alias("y1"))
    return S.grasp_box(b, v.segments().select("clip_id", "seg", "start_us", "end_us"), width=DAY, blocks=v.blocks)


_SPL = "spl AS (SELECT clip_id, seg, start_us, end_us, CASE WHEN seg % 2 = 0 THEN 'action' ELSE 'transition' END AS type FROM (SELECT clip_id, seg // 20 AS seg, min(start_us) AS start_us, max(end_us) AS end_us FROM v_segments GROUP BY 1, 2))"
_VAL = f"""vin AS (SELECT s.clip_id, s.seg, s.start_us, e.t_us, coalesce(energy, 0) AS e FROM spl s JOIN en e ON e.clip_id = s.clip_id AND e.t_us >= s.start_us + {3 * U // 10} AND e.t_us < s.end_us - {U} WHERE s.end_us - s.start_us > {8 * U}),
vme AS (SELECT clip_id, seg, quantile_cont(e, 0.5) AS med FROM vin WHERE e > 0 GROUP BY 1,2),
val AS (SELECT v.clip_id * 1000 + v.seg AS clip_id, v.t_us, v.start_us FROM (SELECT *, lag(e) OVER w AS p, lead(e) OVER w AS n FROM vin WINDOW w AS (PARTITION BY clip_id, seg ORDER BY t_us)) v JOIN vme m ON m.clip_id = v.clip_id AND m.seg = v.seg WHERE med >= 100 AND e * 100 < med * 55 AND e <= p AND e <= n)"""


def long_spans(v):
    g = v.segments().groupBy("clip_id", F.floor(F.col("seg") / 20).alias("seg"))
    return g.agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).withColumn("type", F.when(F.col("seg") % 2 == 0, "action").otherwise("transition"))


@query(
    "refine_long_spans",
    """SELECT b.clip_id, b.seg, b.start_us, b.end_us, CASE WHEN m.med >= 100 THEN 'action' ELSE s.type END AS type FROM (SELECT clip_id, seg, t_us AS start_us, lead(t_us) OVER (PARTITION BY clip_id, seg ORDER BY t_us) AS end_us FROM (
 SELECT clip_id, seg, start_us AS t_us FROM spl UNION SELECT clip_id, seg, end_us FROM spl UNION SELECT clip_id // 1000, clip_id % 1000, t_us FROM vth)) b JOIN spl s ON s.clip_id = b.clip_id AND s.seg = b.seg LEFT JOIN vme m ON m.clip_id = b.clip_id AND m.seg = b.seg WHERE b.end_us IS NOT NULL""",
    *ENERGY, _SPL, _VAL, thin_sql("val", 30 * U, "vth", "start_us"),
)
def _(v):
    return S.refine_long_spans(long_spans(v), energy(v), 8 * U, 30 * U, 3 * U // 10, U, 100.0, 5 * DAY, v.blocks)


@query(
    "energy_valleys",
    "SELECT clip_id // 1000 AS clip_id, clip_id % 1000 AS seg, t_us FROM val",
    *ENERGY,
    _SPL,
    _VAL,
)
def _(v):
    from ..plans.ranges import points_in

    s = long_spans(v).where(F.col("end_us") - F.col("start_us") > 8 * U).select("clip_id", "seg", F.col("start_us").alias("s_us"), "end_us")
    e = energy(v).select("clip_id", "t_us", F.coalesce("energy", F.lit(0)).alias("e"))
    j = points_in(e, s, ["clip_id"], F.col("t_us"), F.col("s_us") + 3 * U // 10, F.col("end_us") - U - 1, 5 * DAY)
    return S.valleys(j.select("clip_id", "seg", "t_us", "e"), ["clip_id", "seg"], v.blocks).where("med >= 100").select("clip_id", "seg", "t_us")


@query(
    "span_samples",
    """SELECT clip_id, seg, frame, CAST(min(o) = 0 AS INT) AS "primary" FROM (SELECT s.clip_id, s.seg, q.o, (SELECT f.frame FROM v_frames f WHERE f.clip_id = s.clip_id ORDER BY abs(f.t_us - (s.start_us + (s.end_us - s.start_us) * q.q // 4)), f.t_us LIMIT 1) AS frame
 FROM v_track_n s, (VALUES (0, 2), (1, 1), (2, 3)) q(o, q)) GROUP BY 1, 2, 3""",
    "v_track_n AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY start_us) - 1 AS seg FROM v_track)",
)
def _(v):
    s = v.ordered(order=("start_us",)).number(v.track(), "seg")
    return S.span_samples(s, v.frames(), v.blocks)


@query("best_detection", "SELECT clip_id, event_type, arg_max(event_id, {'v': signal, 'n': -event_id}) AS det, max(signal) AS conf FROM v_obs WHERE signal IS NOT NULL GROUP BY 1, 2")
def _(v):
    d = v.obs().where("signal IS NOT NULL").select("clip_id", "event_type", F.col("event_id").alias("det"), F.col("signal").alias("conf"))
    return S.best_detection(d, ["clip_id", "event_type"])


def jac_sql(a, b, thr_num, thr_den):
    """labels alike on one hand, as SQL over two normalised labels"""
    ta, tb = f"list_distinct(string_split({a}, ' '))", f"list_distinct(string_split({b}, ' '))"
    return f"({a} = {b} OR ({a} <> 'n/a' AND {b} <> 'n/a' AND len(list_intersect({ta}, {tb})) * {thr_den} >= {thr_num} * len(list_distinct(list_concat({ta}, {tb})))))"


def _norm(c):
    return f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"


_SAME = jac_sql(_norm("f.left_label"), _norm("n.left_label"), 11, 20) + " AND " + jac_sql(_norm("f.right_label"), _norm("n.right_label"), 11, 20)
_M = f"((n.fast = 1 AND f.fast = 1 AND n.dir = f.dir) OR ({_SAME}))"
_FULLER = "(CAST(n.left_label <> 'N/A' AS INT) + CAST(n.right_label <> 'N/A' AS INT) > CAST(f.left_label <> 'N/A' AS INT) + CAST(f.right_label <> 'N/A' AS INT))"
_COMB = f"""ci AS (SELECT clip_id, seg, start_us, end_us, left_label, right_label, CAST(event_type IN ('click','view') AS INT) AS fast, CASE WHEN k < 70 THEN 'screw' ELSE 'unscrew' END AS dir FROM v_coarse_k),
cf AS (SELECT clip_id, seg, start_us, left_label, right_label, fast, dir FROM ci WHERE seg = 0
 UNION ALL SELECT n.clip_id, n.seg, CASE WHEN {_M} THEN f.start_us ELSE n.start_us END, CASE WHEN {_M} AND NOT {_FULLER} THEN f.left_label ELSE n.left_label END, CASE WHEN {_M} AND NOT {_FULLER} THEN f.right_label ELSE n.right_label END,
 CASE WHEN {_M} THEN f.fast ELSE n.fast END, CASE WHEN {_M} THEN f.dir ELSE n.dir END FROM cf f JOIN ci n ON n.clip_id = f.clip_id AND n.seg = f.seg + 1)"""
COARSE_K = "v_coarse_k AS (SELECT clip_id, seg, start_us, end_us, k, event_type, CASE WHEN k < 40 THEN 'hold the big unit' WHEN k < 80 THEN 'hold the big red unit' ELSE 'N/A' END AS left_label, CASE WHEN event_type = 'view' THEN 'N/A' WHEN k % 2 = 0 THEN 'pick up a bolt' ELSE 'pick up a small bolt' END AS right_label FROM v_segments)"


def coarse_k(v):
    return v.segments().select(
        "clip_id", "seg", "start_us", "end_us", "k", "event_type",
        F.when(F.col("k") < 40, "hold the big unit").when(F.col("k") < 80, "hold the big red unit").otherwise("N/A").alias("left_label"),
        F.when(F.col("event_type") == "view", "N/A").when(F.col("k") % 2 == 0, "pick up a bolt").otherwise("pick up a small bolt").alias("right_label"),
    )


@query(
    "comb_segments",
    "SELECT c.clip_id, c.start_us, max(i.end_us) AS end_us, arg_max(c.left_label, c.seg) AS left_label, arg_max(c.right_label, c.seg) AS right_label, count(*) AS n FROM cf c JOIN ci i ON i.clip_id = c.clip_id AND i.seg = c.seg GROUP BY 1, 2",
    COARSE_K,
    _COMB,
)
def _(v):
    s = coarse_k(v)
    rot = s.select("clip_id", "seg", F.col("event_type").isin("click", "view").cast("int").alias("fastening"), F.when(F.col("k") < 70, "screw").otherwise("unscrew").alias("direction"))
    return S.comb(s, rot, 0.55, v.blocks)


@query("absorb_tiny", None)
def _(v):
    return S.absorb_tiny(v.segments(), 6 * U, v.blocks)


@query(
    "spans_or_even",
    """SELECT clip_id, seg, start_us, end_us FROM v_segments WHERE clip_id % 2 = 0
 UNION ALL SELECT clip_id, i AS seg, a + (b - a) * i // 6, a + (b - a) * i // 6 FROM (SELECT clip_id, min(t_us) AS a, max(t_us) AS b FROM v_obs GROUP BY 1), range(0, 7) r(i) WHERE clip_id % 2 = 1 OR clip_id NOT IN (SELECT clip_id FROM v_segments)""",
)
def _(v):
    return S.spans_or_even(v.segments().where(F.col("clip_id") % 2 == 0), v.obs(), 7)
