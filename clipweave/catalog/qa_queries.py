"""Analysis flags and QA findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import analysis as A
from ..operators import qa as Q
from ..operators import timeline as T
from ..plans.cut import cut
from .registry import query
from .text_queries import HANDS, LABEL_WORDS, OBJ_TOKENS, SECTXT, hands, sql_count_contains, sql_in, sql_list, sql_verb
from .timeline_queries import CLEAN, DIRECTION_CTES, SUMMARY, cleaned, runs_sql, summary
from .views import DAY, U

S01, S04, S05, S06, S08 = U // 10, 4 * U // 10, U // 20, 6 * U // 10, 8 * U // 10


def _words_sql(n):
    return f"""wf AS (SELECT clip_id, word, n, row_number() OVER (PARTITION BY clip_id ORDER BY n DESC, f) AS rank FROM (
 SELECT clip_id, word, count(*) AS n, min({{'s': seg, 'h': hand, 'p': p}}) AS f FROM (
  SELECT clip_id, seg, hand, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM (SELECT clip_id, seg, hand, {LABEL_WORDS.format(c='label')} AS ws FROM v_hands)) GROUP BY 1, 2) QUALIFY rank <= {n})"""


@query("word_freq", "SELECT * FROM wf", HANDS, _words_sql(8))
def _(v):
    return A.word_freq(v.segments(), 8)


_KINDS = "SELECT clip_id, count(*) FILTER (kind='pickup') AS pickups, count(*) FILTER (kind='place') AS places FROM v_transitions GROUP BY 1"


@query("transition_kind_counts", _KINDS)
def _(v):
    return A.kind_counts(v.transitions())


_E = f"(lower(touching) IN {sql_in(X.EMPTY_ANALYSIS)})"
STATS = f"""v_touch AS (SELECT clip_id, t_us, 'left' AS hand, left_touching AS touching FROM v_obs UNION ALL SELECT clip_id, t_us, 'right', right_touching FROM v_obs),
stj AS (SELECT s.clip_id, s.seg, f.hand, f.touching, {_E} AS e FROM v_segments s JOIN v_touch f ON f.clip_id = s.clip_id AND f.t_us BETWEEN s.start_us - {S05} AND s.end_us + {S05}),
stats AS (SELECT h.clip_id, h.seg, h.hand, h.label, coalesce(n, 0) AS n, coalesce(ne, 0) AS n_empty, coalesce(touched, []) AS touched FROM v_hands h
 LEFT JOIN (SELECT clip_id, seg, hand, count(*) AS n, count(*) FILTER (e) AS ne FROM stj GROUP BY 1,2,3) c ON c.clip_id=h.clip_id AND c.seg=h.seg AND c.hand=h.hand
 LEFT JOIN (SELECT clip_id, seg, hand, list_sort(list(DISTINCT w)) AS touched FROM (SELECT clip_id, seg, hand, unnest({LABEL_WORDS.format(c='touching')}) AS w FROM stj WHERE NOT e) GROUP BY 1,2,3) t ON t.clip_id=h.clip_id AND t.seg=h.seg AND t.hand=h.hand)"""


def stats(v):
    return A.contact_stats(v.obs(), v.segments(), S05, DAY)


@query("empty_fraction", "SELECT clip_id, seg, hand, CASE WHEN n = 0 THEN 1.0 ELSE n_empty / n END AS empty_fraction FROM stats", HANDS, STATS)
def _(v):
    return A.empty_fraction(stats(v))


@query("touched_words", "SELECT clip_id, seg, hand, array_to_string(touched, ' ') AS touched FROM stats", HANDS, STATS)
def _(v):
    return stats(v).select("clip_id", "seg", "hand", F.array_join("touched", " ").alias("touched"))


# labels that often disagree with the contact seen
_LAB = """v_lab AS (SELECT clip_id, seg, start_us, end_us, CASE WHEN k < 30 THEN 'hold the click' WHEN k < 60 THEN 'hold the view' WHEN k < 80 THEN 'N/A' ELSE 'take the signup' END AS left_label, CASE WHEN k % 3 = 0 THEN 'N/A' ELSE 'take the click part' END AS right_label FROM v_segments)"""
_CAT2 = "v_cat2 AS (SELECT clip_id, list(DISTINCT event_type) AS cat FROM v_obs WHERE event_type IN ('click','view','signup') GROUP BY 1)"
_CROSS = f"""SELECT clip_id, seg, hand, type FROM (SELECT s.clip_id, s.seg, s.hand, CASE WHEN lab <> 'N/A' AND n_empty * 10 >= n * 8 THEN 'contact_says_idle?'
 WHEN lab <> 'N/A' AND len(touched) > 0 AND len(w) > 0 AND NOT list_has_any(w, touched) THEN 'object_unsupported?'
 WHEN lab = 'N/A' AND n > 0 AND n_empty * 10 <= n * 3 AND len(touched) > 0 THEN 'idle_but_holding?' END AS type
 FROM (SELECT t.*, list_intersect(list_distinct({LABEL_WORDS.format(c='lab')}), cat) AS w FROM (SELECT s.*, CASE s.hand WHEN 'left' THEN l.left_label ELSE l.right_label END AS lab FROM stats s JOIN v_lab l ON l.clip_id = s.clip_id AND l.seg = s.seg) t JOIN v_cat2 USING (clip_id)) s) WHERE type IS NOT NULL"""


@query("contact_crosscheck", _CROSS, HANDS, STATS, _LAB, _CAT2)
def _(v):
    k = F.col("k")
    s = v.segments().select(
        "clip_id", "seg", "start_us", "end_us",
        F.when(k < 30, "hold the click").when(k < 60, "hold the view").when(k < 80, "N/A").otherwise("take the signup").alias("left_label"),
        F.when(k % 3 == 0, "N/A").otherwise("take the click part").alias("right_label"),
    )
    cat = v.obs().where(F.col("event_type").isin("click", "view", "signup")).select("clip_id", F.col("event_type").alias("name"), F.lit(None).cast("string").alias("colour")).distinct()
    return A.contact_crosscheck(s, stats(v), cat)


_OUT = f"""outl AS (SELECT s.clip_id, s.seg, end_us - start_us AS dur_us, CAST(med * 2 AS BIGINT) AS median_x2 FROM v_segments s JOIN (
 SELECT clip_id, median(end_us - start_us) AS med, count(*) AS n FROM v_segments GROUP BY 1) m ON m.clip_id = s.clip_id
 WHERE n >= 3 AND med > 0 AND end_us - start_us >= greatest({8 * U}, 6 * med))"""


@query("duration_outliers", "SELECT * FROM outl", _OUT)
def _(v):
    return A.duration_outliers(v.segments(), 8 * U, v.blocks)


# events moved off the boundaries so that both outcomes occur
_EV = "v_ev AS (SELECT clip_id, t_us + CAST(k % 5 AS BIGINT) * 900000000 AS t_us, hand, kind, object FROM (SELECT t.*, o.k FROM v_transitions t JOIN v_obs o ON o.clip_id = t.clip_id AND o.t_us = t.t_us))"


def moved_events(v):
    t = v.transitions().join(v.obs().select("clip_id", "t_us", "k"), ["clip_id", "t_us"])
    return t.withColumn("t_us", F.col("t_us") + (F.col("k") % 5).cast("long") * 900_000_000).drop("k")


def _missed(tol):
    return f"""missed AS (SELECT e.clip_id, e.t_us, e.kind, e.hand, coalesce((SELECT min(seg) FROM v_segments s WHERE s.clip_id = e.clip_id AND e.t_us BETWEEN s.start_us - 50000 AND s.end_us + 50000), 0) AS seg
 FROM v_ev e WHERE NOT EXISTS (SELECT 1 FROM (SELECT clip_id, start_us AS b FROM v_segments WHERE seg > 0 UNION SELECT s.clip_id, end_us FROM v_segments s WHERE seg < (SELECT max(seg) FROM v_segments m WHERE m.clip_id = s.clip_id)) b
 WHERE b.clip_id = e.clip_id AND abs(e.t_us - b.b) <= {tol}))"""


@query("missed_boundaries", "SELECT * FROM missed", _EV, _missed(S06))
def _(v):
    return A.missed_boundaries(v.segments(), moved_events(v), S06, DAY)


@query(
    "static_hands",
    f"""SELECT clip_id, hand, n_words, n, n_empty FROM (SELECT r.clip_id, r.hand, count(*) AS n, count(*) FILTER ({_E}) AS n_empty FROM v_long r GROUP BY 1,2) a
 JOIN (SELECT clip_id, hand, count(DISTINCT w) AS n_words FROM (SELECT clip_id, hand, unnest({LABEL_WORDS.format(c='touching')}) AS w FROM v_long WHERE NOT {_E}) GROUP BY 1,2) b USING (clip_id, hand)
 JOIN v_clips c USING (clip_id) WHERE n_words <= 1 AND n_empty * 100 <= n * 2 AND dur_us > {8 * U}""",
    "v_long AS (SELECT clip_id, 'left' AS hand, 'tray' AS touching FROM v_obs UNION ALL SELECT clip_id, 'right', right_touching FROM v_obs)",
)
def _(v):
    return A.static_hands(v.obs().withColumn("left_touching", F.lit("tray")), v.clips(), 8 * U)


def _fd(lab):
    return f"""fz AS (SELECT e.clip_id, e.t_us, e.hand, e.kind, (SELECT max(seg) FROM {lab} s WHERE s.clip_id = e.clip_id AND abs(s.end_us - e.t_us) <= {S04}) AS sb,
 (SELECT max(seg) FROM {lab} s WHERE s.clip_id = e.clip_id AND abs(s.start_us - e.t_us) <= {S04}) AS sa FROM v_transitions e),
frozen AS (SELECT z.clip_id, z.sa AS seg, z.hand, z.kind, z.t_us, lower(CASE WHEN z.hand = 'left' THEN a.left_label ELSE a.right_label END) AS label FROM fz z
 JOIN {lab} b ON b.clip_id = z.clip_id AND b.seg = z.sb JOIN {lab} a ON a.clip_id = z.clip_id AND a.seg = z.sa WHERE z.sa <> z.sb
 AND lower(CASE WHEN z.hand = 'left' THEN a.left_label ELSE a.right_label END) = lower(CASE WHEN z.hand = 'left' THEN b.left_label ELSE b.right_label END)
 AND (CASE WHEN z.hand = 'left' THEN a.left_label ELSE a.right_label END) <> 'N/A'),
dupx AS (SELECT clip_id, seg + 1 AS seg FROM (SELECT *, lead(left_label) OVER w AS nl, lead(right_label) OVER w AS nr FROM {lab} WINDOW w AS (PARTITION BY clip_id ORDER BY seg)) s
 WHERE left_label = nl AND right_label = nr AND EXISTS (SELECT 1 FROM v_transitions e WHERE e.clip_id = s.clip_id AND abs(s.end_us - e.t_us) <= {S04}))"""


# coarse labels so that neighbours often agree
COARSE = "v_coarse AS (SELECT clip_id, seg, start_us, end_us, CASE WHEN k < 60 THEN 'hold the unit' WHEN k < 90 THEN 'place the unit' ELSE 'N/A' END AS left_label, CASE WHEN event_type IN ('click','view') THEN 'pick up a bolt' ELSE 'drop the nut' END AS right_label FROM v_segments)"


def coarse(v):
    return v.segments().select(
        "clip_id", "seg", "start_us", "end_us",
        F.when(F.col("k") < 60, "hold the unit").when(F.col("k") < 90, "place the unit").otherwise("N/A").alias("left_label"),
        F.when(F.col("event_type").isin("click", "view"), "pick up a bolt").otherwise("drop the nut").alias("right_label"),
    )


@query("frozen_across_events", "SELECT * FROM frozen", COARSE, _fd("v_coarse"))
def _(v):
    return A.frozen_across(coarse(v), v.transitions(), S04, DAY)


@query("dup_across_events", "SELECT * FROM dupx", COARSE, _fd("v_coarse"))
def _(v):
    return A.dup_across(coarse(v), v.transitions(), S04, DAY, v.blocks)


_MONO = "mono AS (SELECT clip_id, seg FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY n DESC, seg) AS r FROM (SELECT clip_id, run, min(seg) AS seg, count(*) AS n FROM cr GROUP BY 1,2)) WHERE r = 1 AND n >= 3)"


@query(
    "timeline_analysis",
    """SELECT clip_id, seg, 'monotone_run?' AS type FROM mono UNION ALL SELECT clip_id, seg, 'duration_outlier?' FROM outl UNION ALL SELECT clip_id, seg, 'missed_boundary?' FROM missed
 UNION ALL SELECT clip_id, seg, 'frozen_across_transition?' FROM frozen UNION ALL SELECT clip_id, seg, 'dup_across_transition?' FROM dupx""",
    COARSE, "v_ev AS (SELECT * FROM v_transitions)", runs_sql("v_coarse", "clip_id", "seg", ["left_label", "right_label"], "cr"), _MONO, _OUT, _missed(S06), _fd("v_coarse"),
)
def _(v):
    return A.timeline_analysis(coarse(v), v.transitions(), U, DAY, v.blocks)


@query(
    "force_rerun",
    "SELECT clip_id, CASE WHEN clip_id % 2 = 0 AND clip_id IN (SELECT clip_id FROM dupx) THEN 'needs_rerun' WHEN clip_id % 2 = 0 THEN 'good' ELSE 'needs_rerun' END AS verdict FROM v_clips",
    COARSE,
    _fd("v_coarse"),
)
def _(v):
    verdicts = v.clips().select("clip_id", F.when(F.col("clip_id") % 2 == 0, "good").otherwise("needs_rerun").alias("verdict"))
    flags = A.dup_across(coarse(v), v.transitions(), S04, DAY, v.blocks).withColumn("type", F.lit("dup_across_transition?"))
    return A.force_rerun(verdicts, flags)


@query(
    "timeline_text",
    f"""SELECT clip_id, seg // 1000 AS page, string_agg('#' || (seg + 1) || '  [' || {SECTXT.format(c='start_us')} || '-' || {SECTXT.format(c='end_us')} || 's] L: ' || left_label || ' R: ' || right_label, chr(10) ORDER BY seg) AS text FROM v_segments GROUP BY 1, 2""",
)
def _(v):
    return A.timeline_text(v.segments())


_SR = f"""SELECT clip_id, seg, 'both' AS hand, 'adjacent_duplicate?' AS type FROM (SELECT *, lag(left_label) OVER w AS pl, lag(right_label) OVER w AS pr FROM v_coarse WINDOW w AS (PARTITION BY clip_id ORDER BY seg)) WHERE pl = left_label AND pr = right_label
 UNION ALL SELECT clip_id, min(seg), hand, 'long_run?' FROM hr GROUP BY clip_id, hand, run HAVING count(*) >= 4
 UNION ALL SELECT clip_id, seg, hand, 'deposit_without_acquire?' FROM (SELECT *, coalesce(sum(CAST(a AS INT)) OVER w, 0) AS na, coalesce(sum(CAST(d AS INT)) OVER w, 0) AS nd FROM (
  SELECT *, {sql_verb('lower(label)', X.PICK_VERBS)} AS a, {sql_verb('lower(label)', X.RELEASE_VERBS)} AS d FROM ch) WINDOW w AS (PARTITION BY clip_id, hand ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE d AND na <= nd"""


@query("sequence_review", _SR, COARSE, "ch AS (SELECT clip_id, seg, 'left' AS hand, left_label AS label FROM v_coarse UNION ALL SELECT clip_id, seg, 'right', right_label FROM v_coarse)", runs_sql("ch", "clip_id, hand", "seg", ["label"], "hr"))
def _(v):
    return A.sequence_review(coarse(v), v.blocks)


def _bal(order, opener, closer, label):
    return f"""SELECT clip_id, object, t_us, '{label}' AS finding FROM (SELECT *, min(bal) OVER (PARTITION BY clip_id, object ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM (
 SELECT *, sum(CASE WHEN kind = '{opener}' THEN 1 ELSE -1 END) OVER (PARTITION BY clip_id, object ORDER BY {order}) AS bal FROM v_transitions WHERE kind IN ('pickup','place'))) WHERE kind = '{closer}' AND bal < least(0, coalesce(low, 0))"""


@query("pick_place_balance", _bal("t_us", "pickup", "place", "place_without_pick") + " UNION ALL " + _bal("-t_us", "place", "pickup", "pick_without_place"))
def _(v):
    return A.pick_place_balance(v.transitions(), v.blocks)


for _mode, _keep in (("drop", "WHERE ok"), ("first", "")):

    @query(
        f"flags_from_review_{_mode}",
        f"SELECT clip_id, CASE WHEN ok THEN k - 1 ELSE 0 END AS seg, event_type AS type, detail FROM (SELECT o.clip_id, o.k, o.event_type, props AS detail, o.k BETWEEN 1 AND n AS ok FROM v_obs o JOIN events e ON e.event_id = o.event_id JOIN (SELECT clip_id, count(*) AS n FROM v_segments GROUP BY 1) c ON c.clip_id = o.clip_id) {_keep}",
    )
    def _(v, mode=_mode):
        o = v.obs().join(v.table("events").select("event_id", "props"), "event_id")
        return A.flags_from_review(o.select("clip_id", F.col("k").alias("seg"), F.col("event_type").alias("type"), F.col("props").alias("detail")), v.segments(), mode)


@query(
    "apply_direction",
    f"""SELECT s.clip_id, CASE WHEN nd IN {sql_in(A.DIRECTIONS)} AND nd <> majority THEN nd ELSE majority END AS direction, CASE WHEN nd IN {sql_in(A.DIRECTIONS)} AND nd <> majority THEN 'needs_rerun' ELSE 'good' END AS verdict,
 CASE WHEN s.clip_id % 2 = 0 THEN 'checked goal' ELSE 'goal' END AS goal FROM (SELECT *, CASE clip_id % 3 WHEN 0 THEN 'assembly' WHEN 1 THEN 'sideways' ELSE 'mixed_or_alternating' END AS nd FROM dsum) s""",
    *DIRECTION_CTES,
    SUMMARY,
)
def _(v):
    state = summary(v).select("clip_id", F.col("majority").alias("direction"), F.lit("goal").alias("goal"))
    m = F.col("clip_id") % 3
    rv = v.clips().select(
        "clip_id",
        F.when(m == 0, "assembly").when(m == 1, "sideways").otherwise("mixed_or_alternating").alias("new_direction"),
        F.lit("good").alias("quality_verdict"),
        F.lit("checked goal").alias("purpose_check"),
        F.when(F.col("clip_id") % 2 == 0, "corrected").otherwise("ok").alias("purpose_verdict"),
    )
    return A.apply_direction(state, rv)


@query("live_flags", "SELECT o.clip_id, k + 1 AS seg, event_type AS type, t_us FROM v_obs o JOIN (SELECT clip_id, max(seg) AS m FROM v_segments GROUP BY 1) s ON s.clip_id = o.clip_id AND k BETWEEN 0 AND m")
def _(v):
    return A.live_flags(v.obs().select("clip_id", F.col("k").alias("seg"), F.col("event_type").alias("type"), "t_us"), v.segments())


@query("flags_by_segment", "SELECT clip_id, k AS seg, string_agg(event_type, ', ' ORDER BY t_us, event_type) AS types, count(*) AS n FROM v_obs GROUP BY 1, 2")
def _(v):
    return A.flags_by_segment(v.obs().select("clip_id", F.col("k").alias("seg"), F.col("event_type").alias("type"), F.col("t_us").alias("ord")))


@query(
    "analysis_report",
    f"""SELECT clip_id, 1 AS line_no, 'label word frequency (most used): ' || string_agg(word || '×' || n, ', ' ORDER BY rank) AS line FROM wf GROUP BY 1
 UNION ALL SELECT clip_id, 3, 'detected transitions: ' || pickups || ' pickup, ' || places || ' place' FROM ({_KINDS})""",
    HANDS,
    _words_sql(8),
)
def _(v):
    return A.report_lines(v.segments(), v.transitions())


@query(
    "catalogue_lines",
    f"""SELECT clip_id, 2 AS line_no, 'catalogue (1A) objects: ' || string_agg(name, ', ' ORDER BY ord, name) AS line FROM cato GROUP BY 1
 UNION ALL SELECT clip_id, 2, '{A.OOV_INTRO}' || string_agg(word, ', ' ORDER BY word) FROM
 (SELECT DISTINCT clip_id, word FROM (SELECT clip_id, unnest({LABEL_WORDS.format(c='label')}) AS word FROM v_hands) w WHERE length(word) > 2 AND NOT regexp_full_match(word, '[0-9]+')
 AND clip_id IN (SELECT clip_id FROM cato) AND NOT EXISTS (SELECT 1 FROM cato c WHERE c.clip_id = w.clip_id AND (c.name = w.word OR c.colour = w.word))) GROUP BY 1""",
    HANDS,
    "cato AS (SELECT clip_id, event_type AS name, 'hold' AS colour, min(event_id) AS ord FROM v_obs WHERE event_type IN ('click', 'view') AND clip_id % 3 > 0 GROUP BY 1, 2)",
)
def _(v):
    o = v.obs().where(F.col("event_type").isin("click", "view") & (F.col("clip_id") % 3 > 0))
    o = o.groupBy("clip_id", F.col("event_type").alias("name")).agg(F.lit("hold").alias("colour"), F.min("event_id").alias("ord"))
    return A.catalogue_lines(v.segments(), o)


# ---- QA ------------------------------------------------------------------------------------------
_QA1 = f"""qc AS (SELECT h.clip_id, h.seg, h.hand, h.label, h.end_us - h.start_us AS dur, CAST(sum(least(t.end_us, h.end_us) - greatest(t.start_us, h.start_us)) FILTER (t.clip_id IS NOT NULL) AS BIGINT) AS cover,
 arg_min(t.object, {{'a': t.start_us, 'b': t.end_us}}) AS object FROM v_hands h LEFT JOIN v_track t ON t.clip_id = h.clip_id AND t.hand = h.hand AND t.end_us > h.start_us + {S01} AND t.start_us < h.end_us - {S01}
 AND lower(trim(t.object)) NOT IN {sql_in(X.EMPTY_CONTACT)} GROUP BY ALL),
qa1 AS (SELECT clip_id, seg, hand, code, detail FROM (SELECT *, CASE WHEN label = 'N/A' AND cover * 10 > dur * 6 AND dur * 10 > {U} * 6 THEN 'NA-WHILE-TRACKED' WHEN label <> 'N/A' AND cover IS NULL AND dur > {U} THEN 'ACTION-WHILE-UNTRACKED' END AS code,
 CASE WHEN label = 'N/A' THEN object ELSE label END AS detail FROM qc) WHERE code IS NOT NULL)"""
_QA2 = f"""ql AS (SELECT *, {OBJ_TOKENS.format(c='label')} AS obj, {sql_verb('lower(label)', X.RELEASE_VERBS)} AS rel, {sql_verb('lower(label)', X.PICK_VERBS)} AS pik FROM v_hands WHERE label <> 'N/A'),
qa2 AS (SELECT q.clip_id, q.seg, q.hand, 'TRACK-MISMATCH' AS code, arg_min(t.object, {{'a': t.start_us, 'b': t.end_us}}) AS detail FROM ql q JOIN v_track t ON t.clip_id = q.clip_id AND t.hand = q.hand
 AND t.object NOT IN {sql_in(X.EMPTY_CONSISTENCY)} AND CASE WHEN q.rel THEN q.start_us BETWEEN t.start_us - {S08} AND t.end_us + {S08} ELSE q.pik AND q.end_us BETWEEN t.start_us - {U // 2} AND t.end_us + {U // 2} END
 WHERE len(q.obj) > 0 GROUP BY 1, 2, 3 HAVING NOT bool_or(list_has_any({OBJ_TOKENS.format(c='t.object')}, q.obj)))"""
_FINE = f"list_filter({sql_list(X.FINE_VERBS)}, lambda w: starts_with(lower({{c}}), w) OR contains(lower({{c}}), ' ' || w))[1]"
_QA3 = f"""qa3 AS (SELECT clip_id, seg, 'both' AS hand, 'PAIR-MIRROR' AS code, {_FINE.format(c='left_label')} AS detail FROM v_segments WHERE left_label <> 'N/A' AND right_label <> 'N/A'
 AND {_FINE.format(c='left_label')} = {_FINE.format(c='right_label')} AND list_has_any({OBJ_TOKENS.format(c='left_label')}, {OBJ_TOKENS.format(c='right_label')}))"""
_DCNT = f"SELECT clip_id, count(*) FILTER ({sql_count_contains('lower(label)', X.ASSEMBLY_LABELS)} > 0) AS asm, count(*) FILTER ({sql_count_contains('lower(label)', X.DISASSEMBLY_LABELS)} > 0) AS dis FROM v_hands GROUP BY 1"
_QA4 = f"""qa4 AS (SELECT d.clip_id, CAST(-1 AS BIGINT) AS seg, 'both' AS hand, 'DIRECTION-CONFLICT' AS code, majority AS detail FROM ({_DCNT}) d JOIN dsum s ON s.clip_id = d.clip_id
 WHERE (majority = 'assembly' AND dis > asm AND dis >= 3) OR (majority = 'disassembly' AND asm > dis AND asm >= 3))"""
QA = (HANDS, _QA1, _QA2, _QA3, *DIRECTION_CTES, SUMMARY, _QA4)


def directions(v):
    return summary(v).select("clip_id", F.col("majority").alias("direction"))


def written(v):
    """Segments, written once, their rows by hand and the levels of blocks that they and the track use."""
    from ..operators.hands import unpivot_hands

    segs = cut(v.segments())
    return segs, unpivot_hands(segs.drop("k", "event_type")), Q.evidence_levels(v.track(), segs, U, DAY)


@query("contact_findings", "SELECT * FROM qa1", HANDS, _QA1)
def _(v):
    _, h, levels = written(v)
    return Q.contact_qa(v.track(), h, U, DAY, levels)


@query("segment_coverage", "SELECT clip_id, seg, hand, cover AS cover_us FROM qc WHERE cover IS NOT NULL", HANDS, _QA1)
def _(v):
    held = v.track().where(~X.is_empty("object", "contact"))
    from ..operators.joins import overlap_join

    j = overlap_join(hands(v), held, ["clip_id", "hand"], S01, DAY)
    return j.groupBy("clip_id", "seg", "hand").agg(F.sum("cover_us").alias("cover_us"))


@query("track_consistency", "SELECT * FROM qa2", HANDS, _QA2)
def _(v):
    _, h, levels = written(v)
    return Q.track_consistency(v.track(), h, U, DAY, levels)


@query("pair_mirror", "SELECT * FROM qa3", _QA3)
def _(v):
    return Q.pair_exclusivity(v.segments())


@query("direction_leaning_counts", _DCNT, HANDS)
def _(v):
    return Q.direction_counts(hands(v))


@query("direction_conflict", "SELECT * FROM qa4", HANDS, *DIRECTION_CTES, SUMMARY, _QA4)
def _(v):
    return Q.direction_conflict(hands(v), directions(v))


@query("run_qa", "SELECT clip_id, seg, hand, code, detail FROM (SELECT * FROM qa1 UNION ALL SELECT * FROM qa2 UNION ALL SELECT * FROM qa3 UNION ALL SELECT * FROM qa4)", *QA)
def _(v):
    segs, h, levels = written(v)
    return Q.run_qa(v.track(), segs, h, directions(v), U, DAY, levels)


# ---- flagship --------------------------------------------------------------------------------------
_FLAG = f"""cl AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY start_us) - 1 AS seg FROM cleaned),
clh AS (SELECT clip_id, seg, start_us, end_us, 'left' AS hand, left_label AS label FROM cl UNION ALL SELECT clip_id, seg, start_us, end_us, 'right', right_label FROM cl),
fq AS (SELECT h.clip_id, h.seg, h.hand, h.label, h.end_us - h.start_us AS dur, CAST(sum(least(t.end_us, h.end_us) - greatest(t.start_us, h.start_us)) FILTER (t.clip_id IS NOT NULL) AS BIGINT) AS cover FROM clh h LEFT JOIN v_track t
 ON t.clip_id = h.clip_id AND t.hand = h.hand AND t.end_us > h.start_us + {S01} AND t.start_us < h.end_us - {S01} AND lower(trim(t.object)) NOT IN {sql_in(X.EMPTY_CONTACT)} GROUP BY ALL),
ff AS (SELECT DISTINCT clip_id, seg FROM fq WHERE (label = 'N/A' AND cover * 10 > dur * 6 AND dur * 10 > {U} * 6) OR (label <> 'N/A' AND cover IS NULL AND dur > {U})
 UNION SELECT clip_id, seg FROM clh WHERE label <> 'N/A' AND regexp_matches(label, '(?i)\\b(and|then|while|before|after)\\b'))"""


@query(
    "timeline_with_findings",
    "SELECT c.clip_id, count(*) AS n_segments, count(f.seg) AS n_review, CAST(sum(end_us - start_us) AS BIGINT) AS covered_us FROM cl c LEFT JOIN ff f ON f.clip_id = c.clip_id AND f.seg = c.seg GROUP BY 1",
    *CLEAN,
    _FLAG,
)
def _(v):
    from ..operators.hands import unpivot_hands
    from ..operators.joins import needs_review

    segs = cut(v.ordered(order=("start_us",)).number(cleaned(v), "seg"))
    h = unpivot_hands(segs)
    reviewed = needs_review(segs, T.chained_labels(h), Q.contact_qa(v.track(), h, U, DAY, Q.evidence_levels(v.track(), segs, U, DAY)))
    return reviewed.groupBy("clip_id").agg(
        F.count("*").alias("n_segments"),
        F.sum("needs_review").alias("n_review"),
        F.sum(F.col("end_us") - F.col("start_us")).alias("covered_us"),
    )
