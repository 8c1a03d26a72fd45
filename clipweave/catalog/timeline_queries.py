"""Run merging, contiguity and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import timeline as T
from .registry import query
from .text_queries import BURSTS, HANDS, NORM, bursts, hands, sql_direction
from .views import U

EPS, MIN = U // 20, U // 2


def runs_sql(src: str, key: str, order: str, same: list[str], name: str) -> str:
    """Gaps-and-islands CTE: ``name`` = rows of ``src`` with a run number."""
    diff = " OR ".join(f"{s} IS DISTINCT FROM lag({s}) OVER w" for s in same)
    return f"""{name}_f AS (SELECT *, CASE WHEN {diff} OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS brk
 FROM {src} WINDOW w AS (PARTITION BY {key} ORDER BY {order})),
{name} AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY {key} ORDER BY {order}) AS BIGINT) AS run FROM {name}_f)"""


_LANES = runs_sql("(SELECT *, lower(trim(label)) AS kk FROM v_hands)", "clip_id, hand", "start_us", ["kk"], "lanes")


@query(
    "run_length_merge",
    "SELECT clip_id, hand, run, min(start_us) AS start_us, arg_max(end_us, start_us) AS end_us, arg_min(label, start_us) AS label, count(*) AS n_rows FROM lanes GROUP BY clip_id, hand, run",
    HANDS,
    _LANES,
)
def _(v):
    return T.run_length_merge(hands(v), ["label"], ["clip_id", "hand"], v.blocks)


_TURN_RUNS = runs_sql("(SELECT *, lower(trim(left_label)) AS kk FROM v_turns)", "clip_id", "start_us", ["kk"], "tr")


@query(
    "run_length_merge_turns",
    "SELECT clip_id, run, min(start_us) AS start_us, arg_max(end_us, start_us) AS end_us, arg_min(left_label, start_us) AS left_label, count(*) AS n_rows FROM tr GROUP BY clip_id, run",
    _TURN_RUNS,
)
def _(v):
    return T.run_length_merge(v.turns(), ["left_label"])


_DERIVED = runs_sql(
    f"(SELECT *, CASE WHEN label = 'N/A' THEN '' ELSE {NORM.format(c='label')} END AS kk FROM v_hands)",
    "clip_id, hand", "start_us", ["kk"], "dt",
)


@query(
    "derive_track",
    "SELECT clip_id, hand, min(start_us) AS start_us, arg_max(end_us, start_us) AS end_us, arg_min(label, start_us) AS object FROM dt WHERE label <> 'N/A' GROUP BY clip_id, hand, run",
    HANDS,
    _DERIVED,
)
def _(v):
    return T.derive_track(hands(v), v.blocks)


_POINTS = f"v_points AS (SELECT * FROM (SELECT clip_id, t_us, {sql_direction('lower(verdict)')} AS direction FROM v_bursts) WHERE direction IS NOT NULL)"
_DRUNS = runs_sql("v_points", "clip_id", "t_us", ["direction"], "dr")
_DR = "druns AS (SELECT clip_id, run, min(direction) AS direction, count(*) AS size, min(t_us) AS start_us FROM dr GROUP BY clip_id, run)"
DIRECTION_CTES = (BURSTS, _POINTS, _DRUNS, _DR)


def points(v):
    return X.direction_points(bursts(v), "verdict", "clip_id", "t_us")


@query(
    "direction_runs",
    "SELECT clip_id, run, direction, size, start_us, CASE WHEN run > 1 THEN start_us END AS switch_us FROM druns",
    *DIRECTION_CTES,
)
def _(v):
    return T.direction_runs(points(v), v.blocks)


@query(
    "recheck_times",
    "SELECT clip_id, start_us AS t_us FROM (SELECT *, count(*) OVER (PARTITION BY clip_id) AS n FROM druns) WHERE size = 1 AND n > 1",
    *DIRECTION_CTES,
)
def _(v):
    return T.recheck_times(T.direction_runs(points(v), v.blocks), v.blocks)


SUMMARY = """dsum AS (SELECT c.clip_id, coalesce(a,0) AS assembly, coalesce(d,0) AS disassembly,
 CASE WHEN coalesce(a,0)+coalesce(d,0)=0 THEN 'none' WHEN a>d THEN 'assembly' WHEN d>a THEN 'disassembly' ELSE 'tie' END AS majority,
 coalesce(runs,0) AS runs, CASE WHEN coalesce(a,0)+coalesce(d,0)=0 THEN 'no_decisive_rotation' WHEN ba>0 AND bd>0 THEN 'mixed_eligible' ELSE 'single_direction_majority' END AS rule
 FROM v_clips c LEFT JOIN (SELECT clip_id, count(*) AS runs, CAST(sum(CASE WHEN direction='ASSEMBLY' THEN size ELSE 0 END) AS BIGINT) AS a,
 CAST(sum(CASE WHEN direction='DISASSEMBLY' THEN size ELSE 0 END) AS BIGINT) AS d,
 count(*) FILTER (direction='ASSEMBLY' AND size>=2) AS ba, count(*) FILTER (direction='DISASSEMBLY' AND size>=2) AS bd FROM druns GROUP BY clip_id) r ON c.clip_id=r.clip_id)"""


def summary(v):
    return T.direction_summary(points(v), T.direction_runs(points(v), v.blocks), v.clips())


@query("direction_summary", "SELECT * FROM dsum", *DIRECTION_CTES, SUMMARY)
def _(v):
    return summary(v)


@query(
    "stabilise_direction",
    """SELECT clip_id, CASE WHEN clip_id % 3 > 0 AND rule='single_direction_majority' AND majority IN ('assembly','disassembly')
 AND assembly+disassembly>=2 THEN majority ELSE CASE WHEN clip_id % 3 = 0 THEN 'assembly' ELSE 'other_or_ambiguous' END END AS direction FROM dsum""",
    *DIRECTION_CTES,
    SUMMARY,
)
def _(v):
    given = v.clips().select(
        "clip_id", F.when(F.col("clip_id") % 3 == 0, "assembly").otherwise("other_or_ambiguous").alias("direction")
    )
    return T.stabilise_direction(given, summary(v))


_COERCE = f"""cz AS (SELECT * FROM (SELECT r.clip_id, greatest(0, least(start_us, dur_us)) AS start_us, greatest(0, least(end_us, dur_us)) AS end_us,
 left_label, right_label FROM v_raw r JOIN v_clips c ON r.clip_id = c.clip_id) WHERE end_us - start_us > {EPS})"""
_DEOV = f"""cn AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY start_us, end_us) AS i FROM cz),
fo AS (SELECT clip_id, i, start_us, end_us, left_label, right_label, end_us - start_us > {EPS} AS kept,
  CASE WHEN end_us - start_us > {EPS} THEN end_us ELSE 0 END AS prev FROM cn WHERE i = 1
 UNION ALL SELECT n.clip_id, n.i, greatest(n.start_us, f.prev), n.end_us, n.left_label, n.right_label,
  n.end_us - greatest(n.start_us, f.prev) > {EPS}, CASE WHEN n.end_us - greatest(n.start_us, f.prev) > {EPS} THEN n.end_us ELSE f.prev END
  FROM fo f JOIN cn n ON n.clip_id = f.clip_id AND n.i = f.i + 1),
deov AS (SELECT clip_id, start_us, end_us, left_label, right_label FROM fo WHERE kept)"""
_BRIDGE = f"""bw AS (SELECT d.*, lag(end_us, 1, 0) OVER w AS pe, lead(end_us) OVER w AS nx, c.dur_us FROM deov d JOIN v_clips c ON d.clip_id = c.clip_id
 WINDOW w AS (PARTITION BY d.clip_id ORDER BY start_us)),
brg AS (SELECT clip_id, start_us, end_us, left_label, right_label FROM deov
 UNION ALL SELECT clip_id, pe, start_us, 'N/A', 'N/A' FROM bw WHERE start_us - pe > {EPS}
 UNION ALL SELECT clip_id, end_us, dur_us, 'N/A', 'N/A' FROM bw WHERE nx IS NULL AND dur_us - end_us > {EPS}
 UNION ALL SELECT clip_id, 0, dur_us, 'N/A', 'N/A' FROM v_clips WHERE clip_id NOT IN (SELECT clip_id FROM deov))"""


def merged_sql(src, name):
    return (
        runs_sql(f"(SELECT *, lower(trim(left_label)) AS kl, lower(trim(right_label)) AS kr FROM {src})", "clip_id", "start_us", ["kl", "kr"], name + "_r")
        + f""",\n{name} AS (SELECT clip_id, min(start_us) AS start_us, arg_max(end_us, start_us) AS end_us, arg_min(left_label, start_us) AS left_label,
 arg_min(right_label, start_us) AS right_label FROM {name}_r GROUP BY clip_id, run)"""
    )


def slivers_sql(src, name, min_us):
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY start_us) AS i, count(*) OVER (PARTITION BY clip_id) AS n,
  end_us - start_us >= {min_us} OR (end_us - s0 >= {min_us} AND coalesce(pe - s0, 0) < {min_us}) AS big FROM (SELECT *, min(start_us) OVER (PARTITION BY clip_id) AS s0,
  max(end_us) OVER (PARTITION BY clip_id ORDER BY start_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {src})),
{name}_b AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY clip_id ORDER BY i), n + 1) AS nxt, row_number() OVER (PARTITION BY clip_id ORDER BY i) AS ord FROM {name}_n WHERE big),
{name} AS (SELECT b.clip_id, CASE WHEN b.ord = 1 THEN f.start_us ELSE b.start_us END AS start_us, l.end_us, b.left_label, b.right_label
  FROM {name}_b b JOIN {name}_n f ON f.clip_id = b.clip_id AND f.i = 1 JOIN {name}_n l ON l.clip_id = b.clip_id AND l.i = b.nxt - 1
 UNION ALL SELECT l.clip_id, f.start_us, l.end_us, l.left_label, l.right_label FROM {name}_n f JOIN {name}_n l ON f.clip_id = l.clip_id AND f.i = 1 AND l.i = l.n
  WHERE f.clip_id NOT IN (SELECT clip_id FROM {name}_b))"""


_R = U // 10
_SNAP = f"""rd AS (SELECT clip_id, (start_us + {_R // 2}) // {_R} * {_R} AS s0, (end_us + {_R // 2}) // {_R} * {_R} AS end_us, left_label, right_label FROM m2),
cleaned AS (SELECT clip_id, coalesce(lag(end_us) OVER (PARTITION BY clip_id ORDER BY s0), s0) AS start_us, end_us, left_label, right_label FROM rd)"""
CLEAN = (_COERCE, _DEOV, _BRIDGE, merged_sql("brg", "m1"), slivers_sql("m1", "sl", MIN), merged_sql("sl", "m2"), _SNAP)


def coerced(v):
    return T.coerce_segments(v.raw(), v.clips(), EPS)


@query("coerce_segments", "SELECT clip_id, start_us, end_us, left_label, right_label FROM cz", _COERCE)
def _(v):
    return coerced(v)


@query("deoverlap", "SELECT * FROM deov", _COERCE, _DEOV)
def _(v):
    return T.deoverlap(coerced(v), EPS, v.blocks)


@query("bridge_gaps", "SELECT * FROM brg", _COERCE, _DEOV, _BRIDGE)
def _(v):
    return T.bridge_gaps(T.deoverlap(coerced(v), EPS, v.blocks), v.clips(), EPS, v.blocks)


@query("absorb_slivers", "SELECT * FROM sv", slivers_sql("(SELECT clip_id, start_us, end_us, left_label, right_label FROM v_segments)", "sv", 4 * U))
def _(v):
    return T.absorb_slivers(v.segments(), 4 * U, v.blocks)


def cleaned(v):
    from ..plans.cut import cut

    return T.clean_timeline(v.raw(), v.clips(), MIN, EPS, _R, v.blocks, cut)


@query("clean_timeline", "SELECT * FROM cleaned", *CLEAN)
def _(v):
    return cleaned(v)


@query("snap_contiguous", "SELECT clip_id, coalesce(lag(end_us) OVER (PARTITION BY clip_id ORDER BY start_us), start_us) AS start_us, end_us, hand, object FROM v_track")
def _(v):
    return T.snap_contiguous(v.track(), v.blocks)


@query(
    "neighbour_context",
    """SELECT clip_id, seg, coalesce(lag(left_label) OVER w, '(start)') AS prev_left, coalesce(lag(right_label) OVER w, '(start)') AS prev_right,
 coalesce(lead(left_label) OVER w, '(end)') AS next_left, coalesce(lead(right_label) OVER w, '(end)') AS next_right FROM v_segments WINDOW w AS (PARTITION BY clip_id ORDER BY seg)""",
)
def _(v):
    return T.neighbour_context(v.segments(), v.blocks).select(
        "clip_id", "seg", "prev_left", "prev_right", "next_left", "next_right"
    )


_TOUCH = "v_tseg AS (SELECT clip_id, seg, split_part(left_label, ' ', 1) AS left_label, event_type AS right_label FROM v_segments)"


@query(
    "monotone_run",
    """SELECT clip_id, seg, run_len FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY run_len DESC, seg) AS r
 FROM (SELECT clip_id, run, min(seg) AS seg, count(*) AS run_len FROM mr GROUP BY clip_id, run)) WHERE r = 1 AND run_len >= 2""",
    _TOUCH,
    runs_sql("v_tseg", "clip_id", "seg", ["left_label", "right_label"], "mr"),
)
def _(v):
    s = v.segments().select("clip_id", "seg", F.split_part("left_label", F.lit(" "), F.lit(1)).alias("left_label"), F.col("event_type").alias("right_label"))
    return T.monotone_run(s, 2, v.blocks)


_BOUNDS = "v_bounds AS (SELECT clip_id, start_us AS t_us FROM v_track UNION SELECT clip_id, end_us FROM v_track)"


@query("boundary_set", "SELECT * FROM v_bounds", _BOUNDS)
def _(v):
    return T.boundary_set(v.track())


@query(
    "spans_from_bounds",
    "SELECT * FROM (SELECT clip_id, t_us AS start_us, lead(t_us) OVER (PARTITION BY clip_id ORDER BY t_us) AS end_us FROM v_bounds) WHERE end_us IS NOT NULL",
    _BOUNDS,
)
def _(v):
    return T.spans_from_bounds(T.boundary_set(v.track()), v.blocks)


@query(
    "interior_boundaries",
    f"SELECT clip_id, t_us FROM (SELECT *, min(t_us) OVER (PARTITION BY clip_id) AS lo, max(t_us) OVER (PARTITION BY clip_id) AS hi FROM v_pred) WHERE t_us > lo + {3 * U // 10} AND t_us < hi - {3 * U // 10}",
)
def _(v):
    return T.interior(v.pred(), 3 * U // 10, v.blocks)


def thin_sql(src, gap, name, anchor="NULL"):
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY t_us) AS i FROM {src}),
{name}_f AS (SELECT clip_id, i, t_us, ({anchor} IS NULL OR t_us - {anchor} >= {gap}) AS keep, CASE WHEN {anchor} IS NULL OR t_us - {anchor} >= {gap} THEN t_us ELSE {anchor} END AS last FROM {name}_n WHERE i = 1
 UNION ALL SELECT n.clip_id, n.i, n.t_us, n.t_us - f.last >= {gap}, CASE WHEN n.t_us - f.last >= {gap} THEN n.t_us ELSE f.last END
 FROM {name}_f f JOIN {name}_n n ON n.clip_id = f.clip_id AND n.i = f.i + 1),
{name} AS (SELECT clip_id, t_us FROM {name}_f WHERE keep)"""


@query("thin_times", "SELECT * FROM th", thin_sql("v_obs", 10 * U, "th"))
def _(v):
    return T.thin(v.obs(), 10 * U, blocks=v.blocks)


@query(
    "segments_from_cuts",
    f"""SELECT * FROM (SELECT clip_id, t_us AS start_us, lead(t_us) OVER (PARTITION BY clip_id ORDER BY t_us) AS end_us FROM (
 SELECT clip_id, 0 AS t_us FROM v_clips UNION SELECT clip_id, dur_us FROM v_clips
 UNION SELECT clip_id, t_us FROM (SELECT k.*, lead(t_us) OVER (PARTITION BY k.clip_id ORDER BY t_us) AS nx, dur_us FROM sc k JOIN v_clips c ON c.clip_id = k.clip_id) WHERE nx IS NOT NULL OR dur_us - t_us >= {8 * U})) WHERE end_us IS NOT NULL""",
    f"inside AS (SELECT DISTINCT p.clip_id, t_us FROM v_pred p JOIN v_clips c ON c.clip_id = p.clip_id WHERE t_us > {U // 5} AND t_us < dur_us - {U // 5})",
    thin_sql("inside", 8 * U, "sc", "CAST(0 AS BIGINT)"),
)
def _(v):
    return T.segments_from_cuts(v.pred(), v.clips(), U // 5, 8 * U, v.blocks)


_GUARD = """gc AS (SELECT c.clip_id, c.dur_us, coalesce(n0,0) AS n0, coalesce(n1,0) AS n1 FROM v_clips c
 LEFT JOIN (SELECT clip_id, count(*) AS n0 FROM v_segments GROUP BY 1) a ON a.clip_id = c.clip_id
 LEFT JOIN (SELECT clip_id, count(*) AS n1 FROM v_segments WHERE event_type IN ('click','view','error') GROUP BY 1) b ON b.clip_id = c.clip_id),
gok AS (SELECT clip_id FROM gc WHERE NOT (n1 < 1 OR (n1 = 1 AND dur_us > 21600000000) OR (n0 >= 5 AND n1 * 10 < n0 * 6)))"""


@query(
    "guard_rewrite",
    """SELECT clip_id, seg, 'rewrite' AS source FROM v_segments WHERE event_type IN ('click','view','error') AND clip_id IN (SELECT clip_id FROM gok)
 UNION ALL SELECT clip_id, seg, 'original' FROM v_segments WHERE clip_id NOT IN (SELECT clip_id FROM gok)""",
    _GUARD,
)
def _(v):
    old = v.segments()
    new = old.where(F.col("event_type").isin("click", "view", "error"))
    return T.guard_rewrite(old, new, v.clips(), 6 * U).select("clip_id", "seg", "source")


@query(
    "chained_labels",
    "SELECT clip_id, seg, hand, 'chained_narrative?' AS type, label AS detail FROM v_hands WHERE label <> 'N/A' AND regexp_matches(label, '(?i)\\b(and|then|while|before|after)\\b')",
    HANDS,
)
def _(v):
    return T.chained_labels(hands(v))
