"""Tracks, events, boundary edits and stitched parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunks as C
from ..operators import tracks as K
from .registry import query
from .signal_queries import COARSE_K, _norm, coarse_k, jac_sql
from .text_queries import SECTXT, sql_in, sql_list
from .timeline_queries import thin_sql
from .views import DAY, U

# fixed contact names with shared words, so that loose matches and empty stretches both occur
NAMES = ["silver bolt", "bolt", "long bolt", "nut plate", "plate", "empty", "none", "", "out of frame", "empty"]
CONTACT = f"""v_contact AS (SELECT clip_id, 'left' AS hand, t_us, {sql_list(NAMES)}[k % 10 + 1] AS object FROM v_obs UNION ALL SELECT clip_id, 'right', t_us, {sql_list(NAMES)}[k // 10 + 1] FROM v_obs)"""


def contact(v):
    names = F.array(*[F.lit(n) for n in NAMES])
    pick = lambda i: F.element_at(names, i.cast("int") + 1)
    row = lambda h, i: F.struct(F.lit(h).alias("hand"), pick(i).alias("object"))
    return v.obs().select("clip_id", "t_us", F.inline(F.array(row("left", F.col("k") % 10), row("right", F.floor(F.col("k") / 10)))))


_W = "list_filter(string_split(lower({c}), ' '), lambda w: length(w) > 3)"
MIN1, GAP1 = 5 * U, 20 * U
TRACK = f"""bn AS (SELECT *, lower(trim(object)) AS ck, lower(trim(object)) IN {sql_in(X.EMPTY_TRACK)} AS emp, row_number() OVER (PARTITION BY clip_id, hand ORDER BY t_us) AS i FROM v_contact),
bf AS (SELECT clip_id, hand, i, t_us, object, emp, CASE WHEN emp THEN NULL ELSE ck END AS key, CASE WHEN emp THEN 1 ELSE 0 END AS er, CASE WHEN emp THEN 0 ELSE 1 END AS iv FROM bn WHERE i = 1
 UNION ALL SELECT n.clip_id, n.hand, n.i, n.t_us, n.object, n.emp,
  CASE WHEN n.emp THEN CASE WHEN f.er + 1 >= 3 THEN NULL ELSE f.key END WHEN f.key IS NOT NULL AND (f.key = n.ck OR list_has_any({_W.format(c='f.key')}, {_W.format(c='n.ck')})) THEN f.key ELSE n.ck END,
  CASE WHEN n.emp THEN f.er + 1 ELSE 0 END,
  f.iv + CASE WHEN n.emp OR (f.key IS NOT NULL AND (f.key = n.ck OR list_has_any({_W.format(c='f.key')}, {_W.format(c='n.ck')}))) THEN 0 ELSE 1 END
  FROM bf f JOIN bn n ON n.clip_id = f.clip_id AND n.hand = f.hand AND n.i = f.i + 1),
bi AS (SELECT clip_id, hand, iv, min(t_us) AS start_us, max(t_us) AS end_us FROM bf WHERE NOT emp GROUP BY 1,2,3 HAVING max(t_us) - min(t_us) >= {MIN1}),
bc AS (SELECT clip_id, hand, iv, arg_max(object, {{'n': n, 'f': -f}}) AS object FROM (SELECT clip_id, hand, iv, object, count(*) AS n, min(i) AS f FROM bf WHERE NOT emp GROUP BY 1,2,3,4) GROUP BY 1,2,3),
bt AS (SELECT i.clip_id, i.hand, start_us, end_us, object FROM bi i JOIN bc c ON c.clip_id = i.clip_id AND c.hand = i.hand AND c.iv = i.iv)"""
_SNAPSQL = """SELECT clip_id, hand, CASE WHEN start_us - pe > 0 AND start_us - pe <= {g} THEN (pe + start_us) // 2 ELSE start_us END AS start_us, CASE WHEN ns - end_us > 0 AND ns - end_us <= {g} THEN (end_us + ns) // 2 ELSE end_us END AS end_us, object
 FROM (SELECT *, lag(end_us) OVER w AS pe, lead(start_us) OVER w AS ns FROM {s} WINDOW w AS (PARTITION BY clip_id, hand ORDER BY start_us))"""
BUILT = "built AS (" + _SNAPSQL.format(g=GAP1, s="bt") + ")"


def built(v):
    return K.build_track(contact(v), MIN1, 3, GAP1, v.blocks)


@query("build_track", "SELECT * FROM built", CONTACT, TRACK, BUILT)
def _(v):
    return built(v)


@query("snap_gaps", _SNAPSQL.format(g=12 * U, s="v_track"))
def _(v):
    return K.snap_gaps(v.track(), 12 * U, v.blocks)


_TOK = "list_sort(list_distinct(list_filter(string_split(lower({c}), ' '), lambda w: length(w) > 3)))"
_TC = f"""tcx AS (SELECT clip_id, t_us FROM v_transitions WHERE kind IN ('place','pickup','handoff')
 UNION ALL SELECT clip_id, (end_us + ns) // 2 FROM (SELECT *, lead(start_us) OVER w AS ns, lead(object) OVER w AS no FROM built WINDOW w AS (PARTITION BY clip_id, hand ORDER BY start_us)) WHERE ns IS NOT NULL AND (ns - end_us >= {30 * U} OR {_TOK.format(c='object')} <> {_TOK.format(c='no')})),
tcc AS (SELECT DISTINCT x.clip_id, t_us FROM tcx x JOIN v_clips c ON c.clip_id = x.clip_id WHERE t_us > {U // 5} AND t_us < dur_us - {U // 5})"""


@query("track_cuts", "SELECT * FROM tct", CONTACT, TRACK, BUILT, _TC, thin_sql("tcc", 6 * U, "tct"))
def _(v):
    return K.track_cuts(built(v), v.transitions(), v.clips(), 30 * U, 6 * U, U // 5, v.blocks)


_A, _B = 5 * DAY, 20 * DAY


@query("clip_intervals", f"SELECT clip_id, hand, object, greatest(start_us, {_A}) AS start_us, least(end_us, {_B}) AS end_us FROM v_track WHERE least(end_us, {_B}) > greatest(start_us, {_A}) + {U // 20}")
def _(v):
    lit = lambda x: F.lit(x).cast("long")
    return K.clip_intervals(v.track(), lit(_A), lit(_B), U // 20)


@query("slice_time", f"SELECT clip_id, t_us, kind FROM v_transitions WHERE t_us BETWEEN {_A} - {U // 20} AND {_B} + {U // 20}")
def _(v):
    return K.slice_time(v.transitions(), _A, _B, U // 20).select("clip_id", "t_us", "kind")


@query("shift_time", f"SELECT clip_id, hand, start_us + clip_id * {U} AS start_us, end_us + clip_id * {U} AS end_us, object FROM v_track")
def _(v):
    return K.shift_time(v.track(), F.col("clip_id") * F.lit(U), ["start_us", "end_us", "object"])


_M3 = 3 * U // 10


@query("locked_transitions", f"SELECT DISTINCT e.clip_id, t_us FROM v_transitions e JOIN v_clips c ON c.clip_id = e.clip_id WHERE t_us > {_M3} AND t_us < dur_us - {_M3}")
def _(v):
    return K.locked_transitions(v.transitions(), v.clips(), _M3)


@query("required_cuts", f"SELECT e.clip_id, t_us, '«' || upper(kind) || '-' || upper(hand) || '» at ' || {SECTXT.format(c='t_us')} || 's' AS hint FROM v_transitions e JOIN v_clips c ON c.clip_id = e.clip_id WHERE t_us > {_M3} AND t_us < dur_us - {_M3}")
def _(v):
    return K.required_cuts(v.transitions(), v.clips(), _M3)


_AT = 6 * U
# input order is by event number within k, so it is not the time order
_GAPS = f"""gp AS (SELECT o.clip_id, t_us + 3 * {U} AS t_us, 'left' AS hand, CASE WHEN k % 2 = 0 THEN 'missing_pick' ELSE 'missing_place' END AS kind, event_type AS object, CAST(k AS BIGINT) * 100000000 + event_id AS ord FROM v_obs o),
gq AS (SELECT g.* FROM gp g JOIN v_clips c ON c.clip_id = g.clip_id WHERE t_us > {U // 2} AND t_us < dur_us - {U // 2} AND NOT EXISTS (SELECT 1 FROM v_transitions h WHERE h.clip_id = g.clip_id AND abs(h.t_us - g.t_us) <= {_AT})),
gi AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY ord) AS i FROM gq),
gr AS (SELECT clip_id, i, t_us, kind, object, hand, true AS keep, [t_us] AS kept FROM gi WHERE i = 1
 UNION ALL SELECT n.clip_id, n.i, n.t_us, n.kind, n.object, n.hand, len(list_filter(f.kept, lambda x: abs(x - n.t_us) <= {_AT})) = 0, CASE WHEN len(list_filter(f.kept, lambda x: abs(x - n.t_us) <= {_AT})) = 0 THEN list_append(f.kept, n.t_us) ELSE f.kept END
 FROM gr f JOIN gi n ON n.clip_id = f.clip_id AND n.i = f.i + 1)"""


@query("add_missing_events", "SELECT clip_id, t_us, hand, CASE WHEN kind = 'missing_pick' THEN 'pickup' ELSE 'place' END AS kind, object FROM gr WHERE keep", _GAPS)
def _(v):
    k = F.col("k").cast("long")
    g = v.obs().select(
        "clip_id", (F.col("t_us") + 3 * U).alias("t_us"), F.lit("left").alias("hand"),
        F.when(F.col("k") % 2 == 0, "missing_pick").otherwise("missing_place").alias("kind"), F.col("event_type").alias("object"), (k * 100_000_000 + F.col("event_id")).alias("ord"),
    )
    return K.add_missing_events(v.transitions(), g, v.clips(), _AT, U // 2, DAY, v.blocks)


# long segments: six events each
SIX = "v_six AS (SELECT clip_id, seg // 6 AS seg, min(start_us) AS start_us, max(end_us) AS end_us, arg_min(left_label, seg) AS left_label, arg_min(right_label, seg) AS right_label FROM v_segments GROUP BY 1, 2)"


def six(v):
    return v.segments().groupBy("clip_id", F.floor(F.col("seg") / 6).alias("seg")).agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.min_by("left_label", "seg").alias("left_label"), F.min_by("right_label", "seg").alias("right_label")
    )


_EC = 8 * U
_ECUT = f"ecx AS (SELECT DISTINCT s.clip_id * 100000 + s.seg AS clip_id, e.t_us, s.start_us FROM v_six s JOIN v_pred e ON e.clip_id = s.clip_id AND e.t_us > s.start_us + {_EC} AND e.t_us < s.end_us - {_EC})"


def _pieces(cuts, lab):
    return f"""SELECT p.clip_id, p.seg, p.start_us, p.end_us, {lab} FROM (SELECT clip_id, seg, t_us AS start_us, lead(t_us) OVER w AS end_us, row_number() OVER w - 1 AS piece FROM (
 SELECT clip_id, seg, start_us AS t_us FROM v_six UNION SELECT clip_id, seg, end_us FROM v_six UNION SELECT clip_id, seg, t_us FROM {cuts}) WINDOW w AS (PARTITION BY clip_id, seg ORDER BY t_us)) p JOIN v_six s ON s.clip_id = p.clip_id AND s.seg = p.seg WHERE p.end_us IS NOT NULL"""


@query("enforce_cuts", _pieces("(SELECT clip_id // 100000 AS clip_id, clip_id % 100000 AS seg, t_us FROM ect)", "s.left_label, s.right_label"), SIX, _ECUT, thin_sql("ecx", _EC + 1, "ect", "start_us"))
def _(v):
    return K.enforce_cuts(six(v), v.pred(), _EC, DAY, v.blocks).drop("piece")


@query(
    "split_unlabelled",
    _pieces("(SELECT DISTINCT s.clip_id, s.seg, e.t_us FROM v_six s JOIN v_pred e ON e.clip_id = s.clip_id AND e.t_us > s.start_us AND e.t_us < s.end_us)", "CASE WHEN piece = 0 THEN left_label END AS left_label, CASE WHEN piece = 0 THEN right_label END AS right_label") + f" AND p.end_us - p.start_us >= {U // 20}",
    SIX,
)
def _(v):
    return K.split_unlabelled(six(v), v.pred(), U // 20, DAY, v.blocks).drop("piece")


def asks(v):
    keep = F.when(F.col("k") % 2 == 0, "after").otherwise("before")
    return v.obs().where(F.col("event_type") == "error").select("clip_id", (F.col("t_us") + (F.col("k") % 9).cast("long") * U).alias("t_us"), keep.alias("keep"))


@query("apply_merges")
def _(v):
    return K.apply_merges(v.segments(), asks(v), v.transitions(), 4 * U, U, DAY, v.blocks)


@query("apply_seam_merges")
def _(v):
    return K.apply_seam_merges(v.segments(), asks(v), v.transitions(), v.track(), 4 * U, U, U, DAY, v.blocks)


@query(
    "apply_corrections",
    """SELECT s.clip_id, s.seg, coalesce(l.label, s.left_label) AS left_label, coalesce(r.label, s.right_label) AS right_label, CASE WHEN l.label IS NOT NULL THEN s.left_label END AS left_from, CASE WHEN r.label IS NOT NULL THEN s.right_label END AS right_from
 FROM v_segments s LEFT JOIN (SELECT clip_id, k AS seg, arg_max(right_touching, t_us) AS label FROM v_obs WHERE event_type IN ('click','view') GROUP BY 1,2) l ON l.clip_id = s.clip_id AND l.seg = s.seg
 LEFT JOIN (SELECT clip_id, k AS seg, arg_max(right_touching, t_us) AS label FROM v_obs WHERE event_type = 'signup' GROUP BY 1,2) r ON r.clip_id = s.clip_id AND r.seg = s.seg""",
)
def _(v):
    t = F.col("event_type")
    fixes = v.obs().where(t.isin("click", "view", "signup")).select("clip_id", F.col("k").cast("long").alias("seg"), F.when(t == "signup", "right").otherwise("left").alias("hand"), F.col("right_touching").alias("label"), F.col("t_us").alias("ord"))
    return K.apply_corrections(v.segments(), fixes).select("clip_id", "seg", "left_label", "right_label", "left_from", "right_from")


def _fuzzy(guard):
    same = jac_sql(_norm("f.left_label"), _norm("n.left_label"), 3, 5) + " AND " + jac_sql(_norm("f.right_label"), _norm("n.right_label"), 3, 5)
    m = f"({guard} AND {same})"
    return f"""fi AS (SELECT clip_id, seg, start_us, end_us, left_label, right_label, EXISTS (SELECT 1 FROM v_transitions e WHERE e.clip_id = s.clip_id AND e.kind = 'place' AND abs(e.t_us - s.start_us) <= {U // 2}) AS g FROM v_coarse_k s),
fw AS (SELECT clip_id, seg, start_us, left_label, right_label FROM fi WHERE seg = 0 UNION ALL SELECT n.clip_id, n.seg, CASE WHEN {m} THEN f.start_us ELSE n.start_us END, CASE WHEN {m} THEN f.left_label ELSE n.left_label END, CASE WHEN {m} THEN f.right_label ELSE n.right_label END
 FROM fw f JOIN fi n ON n.clip_id = f.clip_id AND n.seg = f.seg + 1)"""


_FZ = "SELECT w.clip_id, w.start_us, max(i.end_us) AS end_us, any_value(w.left_label) AS left_label, any_value(w.right_label) AS right_label, count(*) AS n FROM fw w JOIN fi i ON i.clip_id = w.clip_id AND i.seg = w.seg GROUP BY 1, 2"


@query("fuzzy_merge", _FZ, COARSE_K, _fuzzy("true"))
def _(v):
    return K.fuzzy_merge(coarse_k(v), 0.6, None, v.blocks)


@query("fuzzy_merge_guarded", _FZ, COARSE_K, _fuzzy("NOT n.g"))
def _(v):
    ev = v.transitions().where(F.col("kind") == "place")
    return K.fuzzy_merge(K.guarded_boundaries(coarse_k(v), ev, U // 2, DAY), 0.6, "guard", v.blocks)


@query("keep_best_attempt", "SELECT clip_id, arg_min(event_id, {'a': CAST(k >= 80 AS INT) * 0 + CAST(k < 80 AS INT), 'b': -k, 'c': event_id}) AS attempt FROM v_obs GROUP BY 1")
def _(v):
    a = v.obs().select("clip_id", F.when(F.col("k") >= 80, "good").otherwise("needs_rerun").alias("verdict"), F.col("k").alias("n_segments"), F.col("event_id").alias("attempt"))
    return K.keep_best(a)


@query("failing_stage", "SELECT clip_id, seg, CASE WHEN left_label <> right_label THEN 'segment' ELSE 'label' END AS stage FROM v_segments")
def _(v):
    return v.segments().select("clip_id", "seg", K.failing_stage(F.col("left_label"), F.col("right_label")).alias("stage"))


# ---- parts ---------------------------------------------------------------------------------------------
PARTS = f"""v_part AS (SELECT clip_id, seg // 10 AS part, seg % 10 AS seg, start_us - 5 * {DAY} * (seg // 10) AS start_us, end_us - 5 * {DAY} * (seg // 10) AS end_us, left_label, event_type FROM v_segments)"""


def part_segments(v):
    s, p = v.segments(), F.floor(F.col("seg") / 10)
    off = p * F.lit(5 * DAY)
    return s.select("clip_id", p.alias("part"), (F.col("seg") % 10).alias("seg"), (F.col("start_us") - off).alias("start_us"), (F.col("end_us") - off).alias("end_us"), "left_label", "event_type")


@query("part_offsets", "SELECT clip_id, part, coalesce(CAST(sum(n) OVER w AS BIGINT), 0) AS seg_off, coalesce(CAST(sum(m) OVER w AS BIGINT), 0) AS frame_off FROM (SELECT clip_id, part, count(*) AS n, CAST(sum(end_us - start_us) AS BIGINT) AS m FROM v_part GROUP BY 1,2) WINDOW w AS (PARTITION BY clip_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", PARTS)
def _(v):
    p = part_segments(v).groupBy("clip_id", "part").agg(F.count("*").alias("n_segs"), F.sum(F.col("end_us") - F.col("start_us")).alias("n_frames"))
    return C.part_offsets(p, v.blocks).select("clip_id", "part", "seg_off", "frame_off")


@query("merge_parts", "SELECT clip_id, seg, start_us, end_us, left_label FROM v_segments")
def _(v):
    s = part_segments(v)
    parts = s.select("clip_id", "part").distinct().withColumn("off_us", F.col("part") * F.lit(5 * DAY))
    return C.merge_parts(s.drop("event_type"), parts, v.blocks)


_PT = f"""pt_t AS (SELECT clip_id, t_us // (50 * {DAY // 10}) AS part, t_us % (50 * {DAY // 10}) AS t_us, kind FROM v_transitions),
pn AS (SELECT clip_id, part, count(*) AS n FROM v_part GROUP BY 1, 2),
pa AS (SELECT clip_id, part FROM pn UNION SELECT clip_id, part FROM pt_t),
po AS (SELECT clip_id, part, part * 5 * {DAY} AS off_us, coalesce(CAST(sum(n) OVER (PARTITION BY clip_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS segs FROM pa LEFT JOIN pn USING (clip_id, part))"""


@query(
    "merge_part_tables",
    """SELECT 'segments' AS kind, clip_id, seg + segs AS seg, start_us + off_us AS t_us, event_type AS tag FROM v_part JOIN po USING (clip_id, part)
 UNION ALL SELECT 'flags', clip_id, seg + segs, NULL, left_label FROM v_part JOIN po USING (clip_id, part) WHERE event_type = 'error'
 UNION ALL SELECT 'qa', clip_id, seg + segs, NULL, 'one' FROM v_part JOIN po USING (clip_id, part) WHERE event_type = 'purchase'
 UNION ALL SELECT 'qa', clip_id, -1, NULL, 'all' FROM pn
 UNION ALL SELECT 'transitions', clip_id, NULL, t_us + off_us, kind FROM pt_t JOIN po USING (clip_id, part)""",
    PARTS,
    _PT,
)
def _(v):
    s = part_segments(v)
    t, width = v.transitions(), 50 * (DAY // 10)
    t = t.select("clip_id", F.expr(f"t_us div {width}").alias("part"), (F.col("t_us") % width).alias("t_us"), "kind")
    whole = s.select("clip_id", "part").distinct()
    parts = whole.union(t.select("clip_id", "part")).distinct().withColumn("off_us", F.col("part") * F.lit(5 * DAY))
    one = lambda name: s.where(F.col("event_type") == name).select("clip_id", "part", "seg", "left_label")
    qa = one("purchase").withColumn("left_label", F.lit("one")).union(whole.select("clip_id", "part", F.lit(-1).cast("long"), F.lit("all")))
    got = C.merge_part_tables({"segments": s, "transitions": t, "flags": one("error"), "qa": qa}, parts, v.blocks)
    none = F.lit(None).cast("long")
    tall = lambda name, seg, at, tag: got[name].select(F.lit(name).alias("kind"), "clip_id", seg.alias("seg"), at.alias("t_us"), F.col(tag).alias("tag"))
    seg = F.col("seg")
    return (
        tall("segments", seg, F.col("start_us"), "event_type")
        .union(tall("flags", seg, none, "left_label"))
        .union(tall("qa", seg, none, "left_label"))
        .union(tall("transitions", none, F.col("t_us"), "kind"))
    )


@query("merge_direction", "SELECT clip_id, CASE WHEN min(d) IS NOT DISTINCT FROM max(d) THEN min(d) ELSE 'mixed_or_alternating' END AS direction FROM (SELECT clip_id, part, CASE WHEN clip_id % 3 = 0 THEN 'assembly' ELSE nullif(left_label[1:1], 'N') END AS d FROM v_part) GROUP BY 1", PARTS)
def _(v):
    p = part_segments(v)
    d = F.when(F.col("clip_id") % 3 == 0, "assembly").otherwise(F.nullif(F.substring("left_label", 1, 1), F.lit("N")))
    return C.merge_direction(p.select("clip_id", "part", d.alias("direction")))


@query("merge_goal", "SELECT clip_id, string_agg(goal, ' | ' ORDER BY part, goal) AS goal FROM (SELECT clip_id, event_type AS goal, min(part) AS part FROM v_part GROUP BY 1,2) GROUP BY 1", PARTS)
def _(v):
    return C.merge_goal(part_segments(v).select("clip_id", "part", F.col("event_type").alias("goal")))


@query("merge_objects", "SELECT clip_id, lower(left_label) AS key, arg_min(left_label, {'p': part, 's': seg}) AS name FROM v_part GROUP BY 1, 2", PARTS)
def _(v):
    return C.merge_objects(part_segments(v).select("clip_id", "part", F.col("seg").alias("ord"), F.col("left_label").alias("name")))


_SEAM = f"""seams AS (SELECT clip_id, t_us + {U} AS t_us FROM v_obs WHERE event_type = 'error'),
sj AS (SELECT p.clip_id, p.t_us, (SELECT arg_max(seg, {{'e': end_us, 's': -seg}}) FROM v_six s WHERE s.clip_id = p.clip_id AND s.end_us <= p.t_us + {2 * U}) AS li, (SELECT arg_min(seg, {{'e': start_us, 's': seg}}) FROM v_six s WHERE s.clip_id = p.clip_id AND s.start_us >= p.t_us - {2 * U}) AS ri FROM seams p),
sk AS (SELECT j.*, a.start_us AS a_us, b.end_us AS b_us FROM sj j JOIN v_six a ON a.clip_id = j.clip_id AND a.seg = li JOIN v_six b ON b.clip_id = j.clip_id AND b.seg = ri WHERE ri > li AND b.end_us - a.start_us >= {U // 2}),
sg AS (SELECT *, sum(CASE WHEN far IS NULL OR li > far THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY li, t_us) AS job FROM (SELECT *, max(ri) OVER (PARTITION BY clip_id ORDER BY li, t_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM sk)),
jobs AS (SELECT clip_id, CAST(job AS BIGINT) AS job, min(li) AS li, max(ri) AS ri, min(a_us) AS a_us, max(b_us) AS b_us, count(*) AS n_seams FROM sg GROUP BY 1, 2)"""


def jobs(v):
    seams = v.obs().where("event_type = 'error'").select("clip_id", (F.col("t_us") + U).alias("t_us"))
    return C.seam_jobs(six(v), seams, 2 * U, U // 2, v.blocks)


@query("seam_jobs", "SELECT * FROM jobs", SIX, _SEAM)
def _(v):
    return jobs(v)


@query(
    "splice_seams",
    """SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY start_us) - 1 AS seg, start_us, end_us, left_label FROM (SELECT clip_id, start_us, end_us, left_label FROM v_six s WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.clip_id = s.clip_id AND s.seg BETWEEN li AND ri)
 UNION ALL SELECT clip_id, a_us, b_us, 'redone' FROM jobs)""",
    SIX,
    _SEAM,
)
def _(v):
    from ..plans.cut import cut

    j = cut(jobs(v))
    new = j.select("clip_id", "job", F.lit(0).cast("long").alias("start_us"), (F.col("b_us") - F.col("a_us")).alias("end_us"), F.lit("redone").alias("left_label"))
    return C.splice_seams(six(v).select("clip_id", "seg", "start_us", "end_us", "left_label"), j, new, v.blocks)
