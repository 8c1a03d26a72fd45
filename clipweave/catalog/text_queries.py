"""Text functions over segment labels and whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.hands import pivot_hands, unpivot_hands
from .registry import query

HANDS = """v_hands AS (SELECT clip_id, seg, start_us, end_us, 'left' AS hand, left_label AS label FROM v_segments
 UNION ALL SELECT clip_id, seg, start_us, end_us, 'right', right_label FROM v_segments)"""


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def hands(v):
    return unpivot_hands(v.segments().drop("k", "event_type"))


@query("unpivot_hands", "SELECT clip_id, seg, start_us, end_us, hand, label FROM v_hands", HANDS)
def _(v):
    return hands(v)


@query("pivot_hands", "SELECT clip_id, seg, left_label, right_label FROM v_segments")
def _(v):
    return pivot_hands(hands(v), ["clip_id", "seg"], "label")


def _empty_sql():
    cols = []
    for name, words in X.EMPTY_WORDS.items():
        base = "coalesce(right_touching,'')"
        e = base if name == "consistency" else f"lower({base})" if name == "analysis" else f"lower(trim({base}))"
        cols.append(f"CAST(sum(CASE WHEN {e} IN {sql_in(words)} THEN 1 ELSE 0 END) AS BIGINT) AS {name}_n")
    return f"SELECT clip_id, {', '.join(cols)} FROM v_obs GROUP BY clip_id"


@query("empty_vocabularies", _empty_sql())
def _(v):
    return v.obs().groupBy("clip_id").agg(
        *[F.count_if(X.is_empty("right_touching", n)).alias(f"{n}_n") for n in X.EMPTY_WORDS]
    )


LABEL_WORDS = f"list_filter(regexp_extract_all(lower(coalesce({{c}},'')), '[a-z0-9-]+'), lambda w: NOT list_contains({sql_list(X.STOP_WORDS)}, w))"
OBJ_TOKENS = (
    "list_distinct(list_transform(list_filter(regexp_split_to_array(lower(coalesce({c},'')), '[^a-z0-9]+'), "
    f"lambda w: length(w) >= 3 AND NOT list_contains({sql_list(X.STOP_OBJECT)}, w)), "
    "lambda w: CASE WHEN w LIKE '%s' AND length(w) > 4 THEN w[:-2] ELSE w END))"
)
NORM = "trim(regexp_replace(lower(coalesce({c},'N/A')), '\\s+', ' ', 'g'))"
TOKSET = "list_distinct(list_filter(string_split(" + NORM + ", ' '), lambda w: w <> ''))"


@query("label_words", f"SELECT doc_id, array_to_string({LABEL_WORDS.format(c='text')}, ' ') AS words FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.array_join(X.label_words("text"), " ").alias("words"))


@query(
    "object_tokens",
    f"SELECT doc_id, array_to_string(list_sort({OBJ_TOKENS.format(c='text')}), ' ') AS tokens FROM documents",
)
def _(v):
    return v.table("documents").select(
        "doc_id", F.array_join(F.array_sort(X.object_tokens("text")), " ").alias("tokens")
    )


@query(
    "label_verb_and_normal_form",
    f"SELECT clip_id, seg, hand, regexp_extract(lower(label), '[a-z-]+') AS verb, {NORM.format(c='label')} AS normal FROM v_hands",
    HANDS,
)
def _(v):
    return hands(v).select(
        "clip_id", "seg", "hand", X.verb_head("label").alias("verb"), X.normalise_label("label").alias("normal")
    )


_JAC = f"""SELECT clip_id, seg, CASE WHEN len(a)=0 OR len(b)=0 THEN CASE WHEN len(a)=len(b) THEN 1.0 ELSE 0.0 END
 ELSE CAST(len(list_intersect(a,b)) AS DOUBLE)/len(list_distinct(list_concat(a,b))) END AS jaccard
 FROM (SELECT clip_id, seg, {TOKSET.format(c='left_label')} AS a, {TOKSET.format(c='right_label')} AS b FROM {{t}})"""


@query("token_jaccard", _JAC.format(t="v_segments"))
def _(v):
    return v.segments().select("clip_id", "seg", X.token_jaccard("left_label", "right_label").alias("jaccard"))


@query("turn_token_jaccard", _JAC.format(t="v_turns"))
def _(v):
    return v.turns().select("clip_id", "seg", X.token_jaccard("left_label", "right_label").alias("jaccard"))


_VOTE_DROP = sorted(set(X.STOP_VOTE + X.FILLER_VOTE + X.DESCRIPTOR_VOTE))
VOTE_KEY = (
    "CASE WHEN lower(trim(coalesce({c},''))) IN " + sql_in(X.EMPTY_VOTE) + " THEN 'N/A' ELSE coalesce(nullif("
    "array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(trim({c})), '[a-z]+'), "
    f"lambda w: NOT list_contains({sql_list(_VOTE_DROP)}, w)), "
    "lambda w: CASE WHEN w LIKE '%s' AND length(w) > 3 THEN w[:-2] ELSE w END))), ' '), ''), 'N/A') END"
)


@query(
    "vote_keys",
    f"SELECT key, count(*) AS n FROM (SELECT {VOTE_KEY.format(c='text')} AS key FROM documents UNION ALL "
    f"SELECT {VOTE_KEY.format(c='right_touching')} FROM v_obs) GROUP BY key",
)
def _(v):
    names = v.table("documents").select("text").union(v.obs().select("right_touching"))
    return names.select(X.vote_key("text").alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def sql_count_contains(c, words):
    return "(" + " + ".join(f"CAST(contains({c}, '{w.replace(chr(39), chr(39) * 2)}') AS INT)" for w in words) + ")"


def sql_indet(c):
    return f"({c} = '' OR {sql_count_contains(c, X.INDETERMINATE)} > 0)"


def sql_direction(c):
    m = c
    for w in X.DISASSEMBLY_MASK:
        m = f"replace({m}, '{w}', ' ')"
    a, d = sql_count_contains(m, X.ASSEMBLY_PHRASES), sql_count_contains(c, X.DISASSEMBLY_PHRASES)
    return f"CASE WHEN {sql_indet(c)} THEN NULL WHEN {a} > {d} THEN 'ASSEMBLY' WHEN {d} > {a} THEN 'DISASSEMBLY' END"


_ROLE = (
    "CASE WHEN contains(t,'both') THEN 'both_active' WHEN {i} AND NOT l AND NOT r THEN NULL "
    "WHEN (r OR trim(t) IN ('r','r-hand','r hand')) AND NOT (l OR trim(t) IN ('l','l-hand','l hand')) THEN 'actor=right' "
    "WHEN (l OR trim(t) IN ('l','l-hand','l hand')) AND NOT (r OR trim(t) IN ('r','r-hand','r hand')) THEN 'actor=left' END"
)
_HITS = f"list_filter({sql_list(X.COLOURS)}, lambda w: contains(t, w))"
_COLOUR = (
    f"CASE WHEN {sql_count_contains('t', X.MIXED_WORDS)} > 0 THEN 'mixed' WHEN {sql_indet('t')} THEN NULL "
    f"WHEN len({_HITS}) = 1 THEN ({_HITS})[1] WHEN len({_HITS}) > 1 THEN 'mixed' END"
)
# verdict texts: labels, document texts and event texts together
_VERDICTS = """v_texts AS (SELECT 'doc' AS src, doc_id AS id, lower(text) AS t FROM documents
 UNION ALL SELECT 'page', page_id, lower(html) FROM pages
 UNION ALL SELECT 'turn', conv_id * 1000 + turn, lower(text) FROM conversations
 UNION ALL SELECT 'left', clip_id * 1000000 + seg, lower(left_label) FROM v_segments
 UNION ALL SELECT 'right', clip_id * 1000000 + seg, lower(right_label) FROM v_segments)"""


def verdict_texts(v):
    seg = v.segments()
    sid = F.col("clip_id") * 1_000_000 + F.col("seg")
    return (
        v.table("documents")
        .select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"), F.lower("text").alias("t"))
        .union(v.table("pages").select(F.lit("page"), "page_id", F.lower("html")))
        .union(v.table("conversations").select(F.lit("turn"), F.col("conv_id") * 1000 + F.col("turn"), F.lower("text")))
        .union(seg.select(F.lit("left"), sid, F.lower("left_label")))
        .union(seg.select(F.lit("right"), sid, F.lower("right_label")))
    )


@query(
    "verdict_classes",
    f"""SELECT src, id, CAST({sql_indet('t')} AS INT) AS indeterminate, {sql_direction('t')} AS direction,
 {_ROLE.format(i=sql_indet('t'))} AS role, {_COLOUR} AS colour FROM (SELECT *, contains(t,'left') AS l, contains(t,'right') AS r FROM v_texts)""",
    _VERDICTS,
)
def _(v):
    return X.verdict_columns(verdict_texts(v), "t", "src", "id")


# bursts: every observation is one probe answer; its verdict is worded from the event
VERDICT_SQL = """CASE event_type WHEN 'click' THEN 'assembly: the part is screwed on'
 WHEN 'view' THEN 'disassembly, counter-clockwise' WHEN 'signup' THEN 'left hand, silver' WHEN 'purchase' THEN 'right hand, red and blue'
 ELSE 'cannot determine' END"""
KIND_SQL = "CASE WHEN event_type IN ('click','view','error') THEN 'direction' WHEN event_type = 'signup' THEN 'role' ELSE 'colour' END"
BURSTS = f"v_bursts AS (SELECT clip_id, t_us, {KIND_SQL} AS kind, {VERDICT_SQL} AS verdict, left_touching AS evidence FROM v_obs)"


def bursts(v):
    t = F.col("event_type")
    return v.obs().select(
        "clip_id",
        "t_us",
        F.when(t.isin("click", "view", "error"), "direction").when(t == "signup", "role").otherwise("colour").alias("kind"),
        F.when(t == "click", "assembly: the part is screwed on")
        .when(t == "view", "disassembly, counter-clockwise")
        .when(t == "signup", "left hand, silver")
        .when(t == "purchase", "right hand, red and blue")
        .otherwise("cannot determine")
        .alias("verdict"),
        F.col("left_touching").alias("evidence"),
    )


SECTXT = "CAST(({c} * 10 + 500000) // 1000000 // 10 AS VARCHAR) || '.' || CAST(({c} * 10 + 500000) // 1000000 % 10 AS VARCHAR)"


@query(
    "burst_lines",
    f"""SELECT clip_id, t_us, line, CAST(round(CAST(regexp_extract(line, '^t=([0-9.]+)', 1) AS DOUBLE) * 1000000) AS BIGINT) AS parsed_us
 FROM (SELECT clip_id, t_us, 't=' || {SECTXT.format(c='t_us')} || ' ' || d AS line
 FROM (SELECT *, {sql_direction('lower(verdict)')} AS d FROM v_bursts) WHERE d IS NOT NULL)""",
    BURSTS,
)
def _(v):
    b = bursts(v).withColumn("line", X.burst_line("t_us", X.direction_class("verdict")))
    return b.where(F.col("line").isNotNull()).select("clip_id", "t_us", "line", X.burst_time("line").alias("parsed_us"))


@query(
    "chained_label_test",
    "SELECT 'label' AS src, clip_id AS a, seg AS b, hand AS c, CAST(upper(trim(label)) <> 'N/A' AND regexp_matches(label, '(?i)(^|[^\\p{L}\\p{N}_])(and|then|while|before|after)($|[^\\p{L}\\p{N}_])') AS INT) AS chained FROM v_hands"
    " UNION ALL SELECT 'doc', doc_id, 0, lang, CAST(upper(trim(text)) <> 'N/A' AND regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])(and|then|while|before|after)($|[^\\p{L}\\p{N}_])') AS INT) FROM documents",
    HANDS,
)
def _(v):
    docs = v.table("documents")
    return (
        hands(v)
        .select(F.lit("label").alias("src"), F.col("clip_id").alias("a"), F.col("seg").alias("b"), F.col("hand").alias("c"), X.is_chained("label").cast("int").alias("chained"))
        .union(docs.select(F.lit("doc"), "doc_id", F.lit(0).cast("long"), "lang", X.is_chained("text").cast("int")))
    )


# lookbehind is rewritten for RE2: remove 'unscrew' forms, then look for 'screw'
UNS = "regexp_matches({c}, '(?i)\\b(unscrew\\w*|loosen\\w*|undo|undoes|unfasten\\w*)\\b')"
SCR = "(regexp_matches(regexp_replace({c}, '(?i)unscrew', 'un~', 'g'), '(?i)\\bscrew\\w*') OR regexp_matches({c}, '(?i)(tighten\\w*|fasten\\w*|thread\\w*)'))"


@query(
    "rotation_agreement",
    f"""SELECT clip_id, seg, hand, CAST(CASE WHEN d = 'unscrew' THEN u AND NOT s ELSE s AND NOT u END AS INT) AS agrees FROM (
 SELECT h.clip_id, h.seg, h.hand, {UNS.format(c='h.label')} AS u, {SCR.format(c='h.label')} AS s,
 CASE WHEN g.k % 2 = 0 THEN 'unscrew' ELSE 'screw' END AS d FROM v_hands h JOIN v_segments g ON h.clip_id = g.clip_id AND h.seg = g.seg)""",
    HANDS,
)
def _(v):
    h = unpivot_hands(v.segments())
    d = F.when(F.col("k") % 2 == 0, "unscrew").otherwise("screw")
    return h.select("clip_id", "seg", "hand", X.rotation_agrees("label", d).cast("int").alias("agrees"))


def sql_verb(c, verbs):
    return "(" + " OR ".join(f"starts_with({c}, '{w}') OR contains({c}, ' {w}')" for w in verbs) + ")"


@query(
    "verb_matches",
    f"""SELECT clip_id, seg, hand, CAST({sql_verb('lower(label)', X.RELEASE_VERBS)} AS INT) AS release, CAST({sql_verb('lower(label)', X.PICK_VERBS)} AS INT) AS pick,
 list_filter({sql_list(X.FINE_VERBS)}, lambda w: starts_with(lower(label), w) OR contains(lower(label), ' ' || w))[1] AS fine FROM v_hands""",
    HANDS,
)
def _(v):
    return hands(v).select(
        "clip_id",
        "seg",
        "hand",
        X.has_verb("label", X.RELEASE_VERBS).cast("int").alias("release"),
        X.has_verb("label", X.PICK_VERBS).cast("int").alias("pick"),
        X.first_verb("label", X.FINE_VERBS).alias("fine"),
    )


@query(
    "container_part",
    "SELECT clip_id, seg, trim(string_split(left_label || ' with ' || right_label, ' with ')[1]) AS container FROM v_segments",
)
def _(v):
    return v.segments().select(
        "clip_id", "seg", X.container_part(F.concat("left_label", F.lit(" with "), "right_label")).alias("container")
    )


@query(
    "fill_template",
    "SELECT clip_id, seg, 'From ' || start_us || ' to ' || end_us || ': ' || left_label || ' / ' || right_label AS txt FROM v_segments",
)
def _(v):
    t = F.lit("From <<A>> to <<B>>: <<L>> / <<R>>")
    return v.segments().select(
        "clip_id",
        "seg",
        X.fill_template(t, {"A": F.col("start_us"), "B": F.col("end_us"), "L": F.col("left_label"), "R": F.col("right_label")}).alias("txt"),
    )


@query("strip_code_fence", "SELECT event_id, trim(props) AS body FROM events")
def _(v):
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return v.table("events").select("event_id", X.strip_code_fence(fenced).alias("body"))


@query(
    "short_labels",
    """SELECT clip_id, seg, CASE WHEN p = 'N/A' THEN '·' ELSE array_to_string(string_split(p, ' ')[1:2], ' ') END AS short
 FROM (SELECT clip_id, seg, CASE WHEN right_label = 'N/A' THEN left_label ELSE right_label END AS p FROM v_segments)""",
)
def _(v):
    return v.segments().select("clip_id", "seg", X.short_label("left_label", "right_label").alias("short"))


@query(
    "label_fullness",
    "SELECT clip_id, seg, CAST(left_label <> 'N/A' AS INT) + CAST(right_label <> 'N/A' AS INT) AS fullness FROM v_segments",
)
def _(v):
    return v.segments().select("clip_id", "seg", X.fullness("left_label", "right_label").alias("fullness"))


@query(
    "gap_kinds",
    "SELECT event_id, CASE event_type WHEN 'click' THEN 'pickup' WHEN 'view' THEN 'handoff' ELSE 'place' END AS kind FROM events",
)
def _(v):
    raised = (
        F.when(F.col("event_type") == "click", "missing_pick")
        .when(F.col("event_type") == "view", "missing_handoff")
        .otherwise(F.col("event_type"))
    )
    return v.table("events").select("event_id", X.gap_kind(raised).alias("kind"))


@query("frame_numbers", "SELECT event_id, event_id AS n FROM events")
def _(v):
    path = F.concat(F.lit("/clips/"), F.col("user_id"), F.lit("/frame_"), F.lpad("event_id", 9, "0"), F.lit(".jpg"))
    return v.table("events").select("event_id", X.frame_number(path).alias("n"))


_PATHS = """v_paths AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'out/batch/clip' || user_id || '.json'
 WHEN 'view' THEN 'out/v' || (event_id % 60) || 'b/clip' || user_id || '.json'
 WHEN 'error' THEN 'out/x/clip' || user_id || '_v' || (event_id % 60) || '.json' ELSE 'out/x/clip' || user_id || '.json' END AS path FROM events)"""


def paths(v):
    s = lambda c: F.col(c).cast("string")
    n = (F.col("event_id") % 60).cast("string")
    clip = F.concat(F.lit("clip"), s("user_id"))
    t = F.col("event_type")
    return v.table("events").select(
        "event_id",
        F.when(t == "click", F.concat(F.lit("out/batch/"), clip, F.lit(".json")))
        .when(t == "view", F.concat(F.lit("out/v"), n, F.lit("b/"), clip, F.lit(".json")))
        .when(t == "error", F.concat(F.lit("out/x/"), clip, F.lit("_v"), n, F.lit(".json")))
        .otherwise(F.concat(F.lit("out/x/"), clip, F.lit(".json")))
        .alias("path"),
    )


@query(
    "infer_version",
    """SELECT event_id, path, ver, CASE WHEN n < 10 THEN n + 1000 ELSE n END AS rank FROM (SELECT *,
 coalesce(CAST(nullif(regexp_extract(ver, '(\\d+)', 1), '') AS BIGINT), 0) AS n FROM (SELECT event_id, path,
 CASE WHEN string_split(path,'/')[-2] = 'batch' THEN 'v18b' WHEN regexp_full_match(string_split(path,'/')[-2], 'v\\d+\\w*') THEN string_split(path,'/')[-2]
 ELSE coalesce(nullif(regexp_extract(regexp_replace(string_split(path,'/')[-1], '\\.[^.]*$', ''), '_(v\\d+\\w*)$', 1), ''), 'v?') END AS ver FROM v_paths))""",
    _PATHS,
)
def _(v):
    p = paths(v).withColumn("ver", X.infer_version("path"))
    return p.select("event_id", "path", "ver", X.version_rank("ver").alias("rank"))
