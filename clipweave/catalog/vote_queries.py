"""Votes, inventories, plans and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import voting as V
from .registry import query
from .text_queries import BURSTS, SECTXT, VOTE_KEY, _COLOUR, _ROLE, bursts, paths, sql_direction, sql_indet
from .views import DAY, U


@query("vote_gate", "SELECT clip_id, event_type, CAST(sum(q1) * 2 > count(*) OR sum(q2) * 2 > count(*) AS INT) AS gate, CAST(sum(q1) AS BIGINT) AS q1, CAST(sum(q2) AS BIGINT) AS q2 FROM (SELECT clip_id, event_type, CAST(k >= 50 AS INT) AS q1, CAST(k % 2 = 0 AS INT) AS q2 FROM v_obs) GROUP BY 1, 2")
def _(v):
    q = v.obs().select("clip_id", "event_type", (F.col("k") >= 50).cast("int").alias("q1"), (F.col("k") % 2 == 0).cast("int").alias("q2"))
    return V.vote_gate(q, ["clip_id", "event_type"])


_RUNS = f"""v_runs AS (SELECT clip_id, 'right' AS hand, event_id % 3 AS run, t_us, CASE WHEN k % 2 = 0 THEN right_touching ELSE 'the silver ' || event_type || 's' END AS name FROM v_obs),
rn AS (SELECT *, row_number() OVER (PARTITION BY clip_id, run ORDER BY t_us) - 1 AS idx, {VOTE_KEY.format(c='name')} AS key FROM v_runs),
ra AS (SELECT r.clip_id, r.hand, r.idx, r.key, r.name, count(*) AS n, min(run) AS f FROM rn r GROUP BY ALL),
rb AS (SELECT clip_id, hand, idx, key, sum(n) AS n, min(f) AS f, arg_max(name, {{'a': n, 'b': length(name), 'c': -f}}) AS name FROM ra GROUP BY 1,2,3,4)"""


@query("consensus", "SELECT clip_id, hand, idx, CASE WHEN w.key = 'N/A' THEN 'empty' ELSE w.name END AS object, n_runs FROM (SELECT clip_id, hand, idx, arg_max({'key': key, 'name': name}, {'a': n, 'b': -f}) AS w, CAST(sum(n) AS BIGINT) AS n_runs FROM rb GROUP BY 1,2,3)", _RUNS)
def _(v):
    r = v.obs().select(
        "clip_id", F.lit("right").alias("hand"), (F.col("event_id") % 3).alias("run"), "t_us",
        F.when(F.col("k") % 2 == 0, F.col("right_touching")).otherwise(F.concat(F.lit("the silver "), "event_type", F.lit("s"))).alias("name"),
    )
    return V.consensus(r, v.blocks)


_PROP = "v_prop AS (SELECT clip_id, t_us // 86400000000 AS frame, event_id AS ord, CASE WHEN k % 2 = 0 THEN upper(right_touching) ELSE right_touching END AS name FROM v_obs)"


@query("inventory_votes", "SELECT clip_id, key, votes, name, row_number() OVER (PARTITION BY clip_id ORDER BY votes DESC, f) AS rank FROM (SELECT clip_id, lower(name) AS key, count(DISTINCT frame) AS votes, min({'f': frame, 'o': ord}) AS f, arg_min(name, {'f': frame, 'o': ord}) AS name FROM v_prop GROUP BY 1,2)", _PROP)
def _(v):
    p = v.obs().select("clip_id", F.expr("t_us div 86400000000").alias("frame"), F.col("event_id").alias("ord"), F.when(F.col("k") % 2 == 0, F.upper("right_touching")).otherwise(F.col("right_touching")).alias("name"))
    return V.inventory_votes(p)


@query("dominant_name", "SELECT clip_id, arg_max(left_touching, {'n': n, 'f': -f}) AS left_touching FROM (SELECT clip_id, left_touching, count(*) AS n, min(t_us) AS f FROM v_obs GROUP BY 1,2) GROUP BY 1")
def _(v):
    return V.dominant_name(v.obs(), ["clip_id"], "left_touching", "t_us")


@query(
    "derive_goal",
    """SELECT clip_id, string_agg(label, '; ' ORDER BY r) AS goal FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY n DESC, f) AS r FROM (SELECT clip_id, lower(label) AS low, count(*) AS n, min({'s': seg, 'h': hand}) AS f, arg_min(label, {'s': seg, 'h': hand}) AS label FROM (
 SELECT clip_id, seg, 'left' AS hand, left_label AS label FROM v_segments UNION ALL SELECT clip_id, seg, 'right', right_label FROM v_segments) WHERE label <> 'N/A' GROUP BY 1,2)) WHERE r <= 4 GROUP BY 1""",
)
def _(v):
    return V.derive_goal(v.segments())


_BOTHTXT = "lower(verdict || ' ' || evidence)"
_RED = f"""bcls AS (SELECT clip_id, t_us, kind, {sql_direction('lower(verdict)')} AS d, (SELECT {_ROLE.format(i=sql_indet('t'))} FROM (SELECT lower(verdict) AS t, contains(lower(verdict),'left') AS l, contains(lower(verdict),'right') AS r)) AS role,
 (SELECT {_COLOUR} FROM (SELECT lower(verdict) AS t)) AS col, (SELECT {_COLOUR} FROM (SELECT {_BOTHTXT} AS t)) AS col2 FROM v_bursts),
brow AS (SELECT clip_id, t_us, 0 AS part, d AS val FROM bcls WHERE kind = 'direction' UNION ALL SELECT clip_id, t_us, 1, role FROM bcls WHERE kind = 'role' UNION ALL SELECT clip_id, t_us, 2, 'colour=' || CASE WHEN kind = 'role' THEN col2 ELSE col END FROM bcls WHERE kind <> 'direction')"""


@query("burst_reduce", f"SELECT clip_id, line, min(pos) AS pos FROM (SELECT clip_id, t_us * 4 + part AS pos, 't=' || {SECTXT.format(c='t_us')} || ' ' || val AS line FROM brow WHERE val IS NOT NULL) GROUP BY 1, 2", BURSTS, _RED)
def _(v):
    return V.burst_reduce(bursts(v))


def _even_sql(n, name):
    return f"SELECT clip_id, i AS {name}, dur_us * i // n AS start_us, dur_us * (i + 1) // n AS end_us FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT clip_id, dur_us, {n} AS n FROM v_clips))"


_WIN = 36 * U


@query("plan_windows", _even_sql(f"greatest(1, (dur_us + {_WIN} - {_WIN // 100}) // {_WIN})", "win"))
def _(v):
    return V.plan_windows(v.clips(), _WIN)


@query("plan_chunks", _even_sql(f"greatest(1, CAST(ceil(dur_us / {300 * U}) AS BIGINT))", "part"))
def _(v):
    return V.plan_chunks(v.clips(), 300 * U)


@query(
    "plan_probes",
    f"""SELECT clip_id, probe, t_us, kind FROM (SELECT clip_id, probe, (start_us + end_us) // 2 AS t_us, 'direction' AS kind FROM ({_even_sql(f"greatest(4, CAST(round(dur_us / {60 * U}) AS BIGINT))", "probe")})
 UNION ALL SELECT c.clip_id, greatest(4, CAST(round(dur_us / {60 * U}) AS BIGINT)), (start_us + end_us) // 2, 'role' FROM v_clips c JOIN v_segments s ON s.clip_id = c.clip_id AND s.seg = 0)""",
)
def _(v):
    return V.plan_probes(v.clips(), v.segments(), 60 * U)


@query("token_budget", "SELECT clip_id, CAST(floor(258 * 0.0002 * (dur_us / 1000000)) AS BIGINT) AS tokens, CAST(258 * 0.0002 * (dur_us / 1000000) > 115000 AS INT) AS overflow, CASE WHEN 258 * 0.0002 * (dur_us / 1000000) > 115000 THEN CAST(floor(11500000.0 / (258 * (dur_us / 1000000))) AS BIGINT) END AS fps_x100 FROM v_clips".replace("0.0002", "CAST(0.0002 AS DOUBLE)"))
def _(v):
    return V.token_budget(v.clips(), 258, 0.0002)


_NUM = "nm AS (SELECT clip_id, t_us, frame AS i, count(*) OVER (PARTITION BY clip_id) AS n FROM v_frames)"


@query("decimate", "SELECT clip_id, t_us FROM nm WHERE n <= 16 UNION ALL SELECT m.clip_id, m.t_us FROM nm m JOIN (SELECT DISTINCT clip_id, j * n // 16 AS i FROM nm, range(16) r(j) WHERE n > 16) p ON p.clip_id = m.clip_id AND p.i = m.i", _NUM)
def _(v):
    return V.decimate(v.obs().select("clip_id", "t_us"), "t_us", 16, v.blocks)


@query("linspace_pick", "SELECT clip_id, t_us FROM nm WHERE n <= 7 UNION ALL SELECT m.clip_id, m.t_us FROM nm m JOIN (SELECT DISTINCT clip_id, CAST(round_even(j * (n - 1) / 6, 0) AS BIGINT) AS i FROM nm, range(7) r(j) WHERE n > 7) p ON p.clip_id = m.clip_id AND p.i = m.i", _NUM)
def _(v):
    return V.linspace_pick(v.obs().select("clip_id", "t_us"), "t_us", 7, v.blocks)


@query("stride_sample", "SELECT clip_id, t_us FROM nm WHERE i % greatest(1, n // 12) = 0 AND i // greatest(1, n // 12) < 12", _NUM)
def _(v):
    return V.stride_sample(v.obs().select("clip_id", "t_us"), "t_us", 12, v.blocks)


@query("every_kth_frame", "SELECT clip_id, t_us FROM nm WHERE i % 4 = 0", _NUM)
def _(v):
    return V.every_kth(v.obs().select("clip_id", "t_us"), "t_us", 30.0, 8.0, v.blocks)


@query("assign_shards", "SELECT clip_id, t_us, hand, (dense_rank() OVER (PARTITION BY clip_id ORDER BY t_us) - 1) % 4 AS shard FROM (SELECT clip_id, t_us, unnest(['left','right']) AS hand FROM v_obs)")
def _(v):
    d = v.obs().select("clip_id", "t_us", F.explode(F.array(F.lit("left"), F.lit("right"))).alias("hand"))
    return V.assign_shards(d, "t_us", 4, v.blocks)


@query("time_to_frame", "SELECT clip_id, t_us, greatest(0, least(CAST(round_even(t_us * CAST(0.001 AS DOUBLE) / 1000000, 0) AS BIGINT), 2400 - 1)) AS frame FROM v_obs")
def _(v):
    return v.obs().select("clip_id", "t_us", V.time_to_frame(F.col("t_us"), 0.001, F.lit(2400).cast("long")).alias("frame"))


@query("prefer_subset", "SELECT clip_id, seg, hand_day FROM (SELECT *, max(p) OVER (PARTITION BY clip_id, hand_day) AS a FROM (SELECT clip_id, seg, start_us // 86400000000 AS hand_day, CAST(k > 70 AS INT) AS p FROM v_segments)) WHERE p = 1 OR a = 0")
def _(v):
    s = v.segments().select("clip_id", "seg", "k", F.expr("start_us div 86400000000").alias("hand_day"))
    return V.prefer_subset(s, ["clip_id", "hand_day"], F.col("k") > 70).drop("k")


@query("require_inputs", "SELECT clip_id, CAST(clip_id IN (SELECT clip_id FROM v_obs WHERE k = 0) AS INT) AS present FROM v_clips")
def _(v):
    ok, skipped = V.require_inputs(v.clips(), v.obs().where("k = 0").select("clip_id"), ["clip_id"])
    return ok.select("clip_id", F.lit(1).alias("present")).union(skipped.select("clip_id", F.lit(0)))


@query("prompt_counts", "SELECT clip_id, count(DISTINCT start_us) AS frames, count(*) FILTER (hand = 'left') AS left_n, count(*) FILTER (hand = 'right') AS right_n FROM v_track GROUP BY 1")
def _(v):
    return V.prompt_counts(v.track().withColumn("t_us", F.col("start_us")))


@query("ordered_distinct_lines", "SELECT event_type AS line, user_id, min(event_id) AS pos FROM events GROUP BY 1, 2")
def _(v):
    e = v.table("events").select("user_id", F.col("event_type").alias("line"), F.col("event_id").alias("pos"))
    return V.ordered_lines(e, ["user_id"], "pos", "line")
