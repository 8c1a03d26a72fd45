"""Mixing sources to target weights by iterative proportional fitting (operator 5), in DataFrame functions only.

Documents are counted into cells of source, language and topic; the cells' token weights are raked to
the three target marginals in turn, and every document is kept with its cell's calibrated probability,
by a uniform number drawn from its id. The only full pass over texts counts words and finds the topic;
after that, work is on one row a cell. Cell sums combine before they are shuffled, so a hot source costs
no more than a cold one, and the factors return to documents by a join whose small side Spark
broadcasts only under its own size limit.

By default a value's target share is its natural share to the power ``temper``, and ``fraction`` of all tokens
are to be kept. Raking works under the bound p <= 1. A value that has fewer tokens than its target asks for is kept whole,
and the other values of its axis share the rest in proportion to their targets (``settled``); the cells of such values
leave the raking. The other cells are raked until every marginal of the expected sample is within ``TOLERANCE`` of all
tokens of what it should be; where targets bind each other, rounds shrink the error by a steady factor, so every third round
moves on by the geometric series of its last steps. Targets that contradict each other end in a warning, with the nearest
rounds' result. ``report`` lists natural, target and reached shares, and the fraction up to which a target could be met.
Only sums leave the cells: three rows for the scales, a few numbers a round; small tables meet by merge joins, none is broadcast.

Defined cases: a null source or language counts as the value "(none)"; a null or empty text has 0 tokens
and takes its cell's probability; rows that repeat an id share its fate; targets for values that do not occur
are left out and the rest is scaled to 1; a value without a target keeps its natural share; an empty table
gives an empty result; without any token every document stays.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, kept, named, query, table

AXES = ("source", "lang", "topic")
TEMPER = 0.7
FRACTION = 0.75
TOLERANCE = 1e-9
MOST_ROUNDS = 60
STALLED = 12  # rounds without a smaller error, after which the targets count as contradictory
FULL = 1 - 1e-12
WORD = r"[^\x20\x09-\x0D]+"

# What marks the form of a text, first match wins; it stands in for a topic.
FORMS = [("table", " | "), ("shout", "!! "), ("symbols", "### "), ("licensed", "icense")]


def topic_of(text):
    out = F.lit("prose")
    for name, mark in reversed(FORMS):
        out = F.when(text.contains(mark), F.lit(name)).otherwise(out)
    return out


def uniform(doc_id):
    """A number in [0, 1) from the id: the first 32 bits of the MD5 of its decimal form."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def measured(docs: DataFrame, topic=None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) of every document."""
    none = F.lit("(none)")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("source").cast("string"), none).alias("source"),
        F.coalesce(F.col("lang").cast("string"), none).alias("lang"),
        F.coalesce(topic if topic is not None else topic_of(text), none).alias("topic"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
    )


def shares(cells: DataFrame, axis: str, total: float, temper: float, targets: dict[str, float] | None) -> DataFrame:
    """(axis, want): tokens each value should have, summing to ``total``."""
    natural = cells.groupBy(axis).agg(F.sum("tokens").cast("double").alias("mass")).filter("mass > 0")
    part = F.pow(F.col("mass") / F.lit(total), F.lit(temper))
    if targets is not None:
        part = F.col("mass") / F.lit(total)
        for value, share in sorted(targets.items()):
            part = F.when(F.col(axis) == value, F.lit(float(share))).otherwise(part)
    sized = kept(natural.select(axis, part.alias("part")))
    whole = sized.agg(F.sum("part")).first()[0]
    return sized.select(axis, (F.col("part") / F.lit(whole or 1.0) * F.lit(total)).alias("want"))


def marginals(cells: DataFrame, *sums) -> DataFrame:
    """(axis, value, ...): sums over the cells of every value of every axis, in one shuffle."""
    at = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in AXES)))
    return cells.select("*", at.alias("at")).groupBy(F.col("at.axis").alias("axis"), F.col("at.value").alias("value")).agg(*sums)


def scales(values: DataFrame, goal: float, first: float) -> dict[str, float]:
    """The factor of each axis at which its values' ``want`` times it, kept between ``low`` and ``mass``, sum to ``goal``: Newton's
    method on a piecewise linear sum, bracketed."""
    at, under, over = dict.fromkeys(AXES, first), dict.fromkeys(AXES, 0.0), dict.fromkeys(AXES, math.inf)
    for _ in range(100):
        x = F.lit(0.0)
        for a in AXES:
            x = F.when(F.col("axis") == a, F.col("want") * F.lit(at[a])).otherwise(x)
        got = F.sum(F.greatest("low", F.least("mass", x))).alias("got")
        up = F.sum(F.when((x >= F.col("low")) & (x < F.col("mass")), F.col("want"))).alias("up")
        down = F.sum(F.when((x > F.col("low")) & (x <= F.col("mass")), F.col("want"))).alias("down")
        moved = False
        for r in values.groupBy("axis").agg(got, up, down).collect():  # three rows
            a, gap = r["axis"], goal - r.got
            slope = r.up if gap > 0 else r.down
            if abs(gap) <= 1e-12 * goal or (gap > 0 and not slope and over[a] == math.inf):
                continue
            if gap > 0:
                under[a] = at[a]
            else:
                over[a] = at[a]
            step = at[a] + gap / slope if slope else -1.0
            if not under[a] < step < over[a]:
                step = 2 * under[a] if over[a] == math.inf else (under[a] + over[a]) / 2
            moved = moved or step != at[a]
            at[a] = step
        if not moved:
            break
    return at


def settled(cells: DataFrame, wants: DataFrame, total: float, fraction: float) -> tuple[DataFrame, DataFrame]:
    """``cells`` with ``held``, true where a value of the cell is kept whole, and (axis, value, want): the tokens that the other
    cells of every value should give. Holding cells of one axis binds the others, so it is repeated until no more join."""
    goal, before = fraction * total, 0
    cells = kept(cells.select(*AXES, "tokens", F.lit(False).alias("held")))
    while True:
        low = F.sum(F.when(F.col("held"), F.col("tokens")).otherwise(0)).cast("double").alias("low")
        mass = F.sum("tokens").cast("double").alias("mass")
        values = kept(wants.join(marginals(cells, low, mass).hint("merge"), ["axis", "value"]))
        at = scales(values, goal, fraction)
        x = F.lit(0.0)
        for a in AXES:
            x = F.when(F.col("axis") == a, F.col("want") * F.lit(at[a])).otherwise(x)
        now = kept(values.select("axis", "value", (F.greatest("low", F.least("mass", x)) - F.col("low")).alias("want"), (x >= F.col("mass") * F.lit(FULL)).alias("full")))
        more = cells
        for a in AXES:
            full = now.filter((F.col("axis") == a) & F.col("full")).select(F.col("value").alias(a), F.lit(True).alias("full"))
            more = more.join(full.hint("merge"), a, "left").select(*AXES, "tokens", (F.col("held") | F.coalesce("full", F.lit(False))).alias("held"))
        more = kept(more)
        s = more.filter("held").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).first()
        if s.n == before or (s.tokens or 0) > goal:
            return cells, now.drop("full")
        before, cells = s.n, more


def rake(
    rows: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    temper: float = TEMPER,
    fraction: float = FRACTION,
) -> DataFrame:
    """(source, lang, topic, weight, p): the probability the documents of each cell stay with, and ``weight``, p over ``fraction``."""
    cells = kept(rows.groupBy(*AXES).agg(F.sum("tokens").alias("tokens")))
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return cells.select(*AXES, F.lit(1.0).alias("weight"), F.lit(1.0).alias("p"))
    wants = None
    for a in AXES:
        one = shares(cells, a, total, temper, (targets or {}).get(a)).select(F.lit(a).alias("axis"), F.col(a).alias("value"), "want")
        wants = one if wants is None else wants.unionByName(one)
    cells, rest = settled(cells, kept(wants), total, fraction)
    aims = {a: rest.filter(F.col("axis") == a).select(F.col("value").alias(a), "want").hint("merge") for a in AXES}
    none = F.lit(None).cast("double")
    now = kept(cells.filter("not held").select(*AXES, "tokens", F.lit(float(fraction)).alias("u"), none.alias("x1"), none.alias("x2")))
    free = F.col("u") < 1
    has = F.sum(F.col("tokens") * F.least("u", F.lit(1.0))).alias("has")
    full = F.sum(F.when(~free, F.col("tokens")).otherwise(0)).alias("full")
    open_ = F.sum(F.when(free, F.col("tokens") * F.col("u")).otherwise(0.0)).alias("open")
    # upwards only cells below 1 give more; downwards all are lowered, and those that stay above 1 are lowered again
    factor = F.when(F.col("want") >= F.col("has"), F.try_divide(F.col("want") - F.col("full"), "open")).otherwise(F.try_divide("want", "has"))
    moved = F.least(F.col("u") * F.coalesce("step", F.lit(1.0)), F.lit(1e9)).alias("u")
    log = F.log(F.greatest("u", F.lit(1e-12)))
    least, since = math.inf, 0
    for n in range(MOST_ROUNDS):
        for a in AXES:
            step = now.groupBy(a).agg(has, full, open_).join(aims[a], a).select(a, factor.alias("step"))
            now = kept(now.join(step.hint("merge"), a, "left").select(*AXES, "tokens", moved, "x1", "x2"))
        off = marginals(now, has).join(rest.hint("merge"), ["axis", "value"]).agg(F.max(F.abs(F.col("has") - F.col("want")))).first()[0] or 0.0
        if off <= TOLERANCE * total:
            break
        least, since = (off, 0) if off < 0.9 * least else (least, since + 1)
        if since == STALLED:
            break
        if n % 3 < 2:
            now = now.withColumn(("x1", "x2")[n % 3], log)
            continue
        d1, d2 = F.col("x2") - F.col("x1"), log - F.col("x2")
        s = now.agg(F.sum(d1 * d2).alias("both"), F.sum(d1 * d1).alias("one")).first()
        ratio = min(max(s.both / s.one, 0.0), 0.95) if s.one else 0.0
        onward = F.exp(F.least(F.greatest(log + d2 * F.lit(ratio / (1 - ratio)), F.lit(-20.0)), F.lit(20.0)))
        now = now.select(*AXES, "tokens", onward.alias("u"), none.alias("x1"), none.alias("x2"))
    if off > TOLERANCE * total:
        warnings.warn(f"mixing: the targets contradict each other by {off / total:.2g} of all tokens", stacklevel=2)
    p = F.least("u", F.lit(1.0)).alias("p")
    all_ = now.select(*AXES, p).unionByName(cells.filter("held").select(*AXES, F.lit(1.0).alias("p")))
    return kept(all_.select(*AXES, (F.col("p") / F.lit(float(fraction))).alias("weight"), "p"))


def report(rows: DataFrame, cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, fraction: float = FRACTION) -> DataFrame:
    """(axis, value, natural, target, share, most, met): for every value its shares of all tokens, of the target and of the
    expected sample of ``cells``; the largest fraction at which its own tokens suffice; whether its tokens meet the target
    at ``fraction``, within a millionth of all tokens."""
    each = kept(rows.groupBy(*AXES).agg(F.sum("tokens").alias("tokens")).join(cells, list(AXES)))
    s = each.agg(F.sum("tokens").alias("all"), F.sum(F.col("tokens") * F.col("p")).alias("left")).first()
    total, left = float(s["all"] or 0), float(s["left"] or 0)
    out = None
    for a in AXES:
        now = each.groupBy(a).agg(F.sum("tokens").alias("mass"), F.sum(F.col("tokens") * F.col("p")).alias("has"))
        one = now.join(shares(each, a, total, temper, (targets or {}).get(a)), a).select(
            F.lit(a).alias("axis"),
            F.col(a).alias("value"),
            (F.col("mass") / F.lit(total)).alias("natural"),
            (F.col("want") / F.lit(total)).alias("target"),
            F.try_divide("has", F.lit(left)).alias("share"),
            F.least(F.lit(1.0), F.coalesce(F.try_divide("mass", "want"), F.lit(1.0))).alias("most"),
            (F.abs(F.col("has") - F.col("want") * F.lit(fraction)) <= F.lit(1e-6 * total)).alias("met"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def mix(docs: DataFrame, targets=None, topic=None, **options) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, weight, p, kept) of every document."""
    rows = kept(measured(docs, topic))
    cells = rake(rows, targets, **options)
    out = rows.join(cells, list(AXES))
    return out.select("doc_id", *AXES, "tokens", F.round("weight", 6).alias("weight"), F.round("p", 6).alias("p"), (uniform(F.col("doc_id")) < F.col("p")).alias("kept"))


def sample(docs: DataFrame, targets=None, **options) -> DataFrame:
    """The documents that stay, with all their columns."""
    rows = kept(measured(docs))
    cells = rake(rows, targets, **options)
    none = F.lit("(none)")
    source, lang, topic, p = fresh(docs, "_source", "_lang", "_topic", "_p")
    keyed = docs.select(
        *named(docs),
        F.coalesce(F.col("source").cast("string"), none).alias(source),
        F.coalesce(F.col("lang").cast("string"), none).alias(lang),
        topic_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(topic),
    )
    small = cells.select(F.col("source").alias(source), F.col("lang").alias(lang), F.col("topic").alias(topic), F.col("p").alias(p))
    return keyed.join(small, [source, lang, topic]).filter(uniform(F.col("doc_id")) < F.col(p)).select(*named(docs))


def sql(rounds: int = 40, passes: int = 3, temper: float = TEMPER, fraction: float = FRACTION) -> str:
    """The same sample, by plain rounds; the scales are read off at the breakpoints of their piecewise linear sums."""
    cases = " ".join(f"WHEN contains(coalesce(text, ''), '{mark}') THEN '{name}'" for name, mark in FORMS)
    out = [
        f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, CASE {cases} ELSE 'prose' END AS topic,
  len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS tokens FROM documents)""",
        "h0 AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens, false AS held FROM d GROUP BY ALL)",
        "t AS MATERIALIZED (SELECT sum(tokens) AS total FROM h0)",
    ]
    for a in AXES:
        out.append(f"n_{a} AS MATERIALIZED (SELECT {a}, pow(sum(tokens) / (SELECT total FROM t), {temper}) AS part FROM h0 GROUP BY {a} HAVING sum(tokens) > 0)")
        out.append(f"w_{a} AS MATERIALIZED (SELECT {a}, part / (SELECT sum(part) FROM n_{a}) * (SELECT total FROM t) AS want FROM n_{a})")
    for i in range(passes):
        for a in AXES:
            out.append(
                f"v{i}_{a} AS MATERIALIZED (SELECT {a}, want, coalesce(sum(tokens) FILTER (held), 0) AS low, sum(tokens) AS mass FROM w_{a} JOIN h{i} USING ({a}) GROUP BY ALL)"
            )
            out.append(
                f"b{i}_{a} AS MATERIALIZED (SELECT b, sum(greatest(low, least(mass, want * b))) AS got, sum(want) FILTER (want * b >= low * {FULL!r} AND want * b < mass * {FULL!r}) AS up "
                f"FROM v{i}_{a}, (SELECT 0 AS b UNION SELECT low / want FROM v{i}_{a} UNION SELECT mass / want FROM v{i}_{a}) GROUP BY b)"
            )
            out.append(
                f"s{i}_{a} AS MATERIALIZED (SELECT max_by(b + coalesce(({fraction} * (SELECT total FROM t) - got) / up, 0), b) AS s FROM b{i}_{a} WHERE got <= {fraction} * (SELECT total FROM t))"
            )
            out.append(
                f"r{i}_{a} AS MATERIALIZED (SELECT {a}, greatest(low, least(mass, want * s)) - low AS want, want * s >= mass * {FULL!r} AS whole_{a} FROM v{i}_{a}, s{i}_{a})"
            )
        out.append(
            f"h{i + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, held OR coalesce(whole_source, false) OR coalesce(whole_lang, false) OR coalesce(whole_topic, false) AS held "
            f"FROM h{i} " + " ".join(f"LEFT JOIN (SELECT {a}, whole_{a} FROM r{i}_{a}) USING ({a})" for a in AXES) + ")"
        )
    last = passes - 1
    out.append(f"c0 AS MATERIALIZED (SELECT source, lang, topic, tokens, {fraction}::DOUBLE AS u FROM h{last} WHERE NOT held)")
    n = 0
    for _ in range(rounds):
        for a in AXES:
            step = "CASE WHEN want >= has THEN (want - whole) / nullif(part, 0) ELSE want / nullif(has, 0) END"
            out.append(
                f"c{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, least(u * coalesce({step}, 1), 1e9) AS u FROM c{n} LEFT JOIN r{last}_{a} USING ({a}) LEFT JOIN "
                f"(SELECT {a}, sum(tokens * least(u, 1)) AS has, sum(CASE WHEN u >= 1 THEN tokens ELSE 0 END) AS whole, sum(CASE WHEN u < 1 THEN tokens * u ELSE 0 END) AS part FROM c{n} GROUP BY {a}) USING ({a}))"
            )
            n += 1
    return (
        ",\n".join(out)
        + f""",
q AS (SELECT source, lang, topic, least(u, 1) AS p FROM c{n} UNION ALL SELECT source, lang, topic, 1 FROM h{last} WHERE held)
SELECT doc_id, source, lang, topic, tokens, round(p / {fraction}, 6) AS weight, round(p, 6) AS p,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < p AS kept
FROM d JOIN q USING (source, lang, topic)"""
    )


@query("op5_mixing", sql())
def op5(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))
