"""Range joins against nested loops, with spans from instants to days."""

import random

import pytest
from pyspark.sql import functions as F

from clipweave.operators.joins import edge_segment, label_at, owner_segment
from clipweave.plans import ranges
from clipweave.plans.ordered import Blocks, Ordered

S = 1_000_000
WIDTH = 10 * S


def spans_of(rng, n):
    out = []
    for i in range(n):
        lo = rng.randint(-50 * S, 4 * 86_400 * S)
        out.append((rng.choice("ab"), i, lo, lo + rng.choice([0, 1, S, 9 * S, 161 * S, 3600 * S, 86_400 * S, 900 * 86_400 * S, -5])))
    return out


@pytest.fixture(params=[1, 2])
def data(request, spark):
    rng = random.Random(request.param)
    spans = spans_of(rng, 60)
    edges = [t for _, _, a, b in spans for t in (a, b, b + 1, a - 1)]
    points = [(rng.choice("ab"), i, rng.choice(edges)) for i in range(300)] + [("c", 300, 5), ("a", 301, None)]
    return (
        spans,
        points,
        spark.createDataFrame(spans, "clip_id string, seg long, start_us long, end_us long"),
        spark.createDataFrame(points, "clip_id string, p long, t_us long"),
    )


def test_points_in_matches_nested_loop(data, rows):
    spans, points, s, p = data
    want = sorted((i, j) for c, i, t in points for d, j, a, b in spans if c == d and t is not None and a <= t <= b)
    levels = ranges.levels_in_use(s, F.col("start_us"), F.col("end_us"), WIDTH)
    assert levels == [0, 1, 2]
    for use in (ranges.LEVELS, levels):
        got = ranges.points_in(p, s, ["clip_id"], F.col("t_us"), F.col("start_us"), F.col("end_us"), WIDTH, levels=use)
        assert rows(got, "p", "seg") == want and got.columns == ["clip_id", "p", "t_us", "seg", "start_us", "end_us"]


def test_semi_and_anti_need_a_length(data, rows):
    spans, points, s, p = data
    call = lambda how, **kw: ranges.points_in(p, s, ["clip_id"], F.col("t_us"), F.col("start_us") - S, F.col("start_us") + S, WIDTH, how, **kw)
    near = lambda c, t: t is not None and any(c == d and abs(t - a) <= S for d, _, a, _ in spans)
    assert rows(call("left_semi", length=2 * S), "p") == sorted((i,) for c, i, t in points if near(c, t))
    assert rows(call("left_anti", length=2 * S), "p") == sorted((i,) for c, i, t in points if not near(c, t))
    with pytest.raises(ValueError):
        call("left_anti")


def test_picked_gives_every_point_back(data, rows):
    spans, points, s, p = data
    twice = p.union(p.where("p < 5"))
    got = ranges.picked(twice, s, ["clip_id"], F.col("t_us"), F.col("start_us"), F.col("end_us"), WIDTH, {"low": F.min("seg"), "n": F.count("seg")})
    at = lambda c, t: [j for d, j, a, b in spans if c == d and t is not None and a <= t <= b]
    assert sorted(((r.p, r.low, r.n) for r in got.collect()), key=repr) == sorted(((i, min(at(c, t), default=None), len(at(c, t))) for c, i, t in points + points[:5]), key=repr)


def test_overlapping_gives_each_pair_once(data, rows, spark):
    spans, _, s, _ = data
    other = spans_of(random.Random(9), 50)
    o = spark.createDataFrame(other, "clip_id string, id long, lo long, hi long")
    got = ranges.overlapping(s, o, ["clip_id"], (F.col("start_us"), F.col("end_us")), (F.col("lo"), F.col("hi")), WIDTH)
    want = sorted((i, j) for c, i, a, b in spans for d, j, x, y in other if c == d and a <= b and x <= y and a <= y and x <= b)
    assert rows(got, "seg", "id") == want


def test_a_span_is_stored_a_bounded_number_of_times(spark):
    lengths = [0, S, 159 * S, 160 * S, 3600 * S, 11 * 3600 * S, 86_400 * S, 100 * 86_400 * S]
    s = spark.createDataFrame([(i, 7 * i, 7 * i + n) for i, n in enumerate(lengths)], "i long, a long, b long")
    once = ranges._stored(ranges._spans(s, F.col("a"), F.col("b"), WIDTH), F.array("_own"), WIDTH)
    assert max(r[1] for r in once.groupBy("i").count().collect()) <= ranges.COPIES + 1


def test_only_long_clips_are_cut_into_blocks(spark, rows):
    df = spark.range(1000).selectExpr("if(id < 900, 'long', concat('c', id % 10)) as clip_id", "id * 1000 as t_us", "id % 7 = 0 as same")
    blocks = Blocks.measure(df, ["clip_id"], "t_us", limit=100)
    assert [r.clip_id for r in blocks.hot.collect()] == ["long"]
    assert df.where("clip_id = 'long'").groupBy(F.floor(F.col("t_us") / blocks.width)).count().agg(F.max("count")).first()[0] <= 100
    assert Blocks.measure(df, ["clip_id"], "t_us", limit=900) is None
    for b in (blocks, Blocks(blocks.width), Blocks(37_000)):
        plain, cut_up = Ordered(["clip_id"], ["t_us"]), Ordered(["clip_id"], ["t_us"], b)
        for of in (lambda o: o.islands(df, {"s": F.col("same")}), lambda o: o.islands(df, {"s": F.floor(F.col("t_us") / 150_000)}), lambda o: o.number(df, "run")):
            assert rows(of(plain), "clip_id", "t_us", "run") == rows(of(cut_up), "clip_id", "t_us", "run")


def test_a_column_named_col_stays(spark, rows):
    segs = spark.createDataFrame([("a", 0, 0, 10), ("a", 1, 10, 20)], "clip_id string, seg long, start_us long, end_us long")
    ev = spark.createDataFrame([("a", 5, "x"), ("a", 5, "x"), ("a", 15, "y")], "clip_id string, t_us long, col string")
    assert rows(owner_segment(ev, segs, 0), "t_us", "col", "seg") == [(5, "x", 0), (5, "x", 0), (15, "y", 1)]
    assert rows(label_at(ev, segs, "closed"), "t_us", "col", "seg") == [(5, "x", 0), (5, "x", 0), (15, "y", 1)]
    assert edge_segment(ev, segs, "before", 5).columns == ["clip_id", "t_us", "col", "seg"]


def test_overlapping_with_the_levels_in_use(data, rows, spark):
    _, _, s, _ = data
    o = spark.createDataFrame(spans_of(random.Random(9), 50), "clip_id string, id long, lo long, hi long")
    a, b = (F.col("start_us"), F.col("end_us")), (F.col("lo"), F.col("hi"))
    want = rows(ranges.overlapping(s, o, ["clip_id"], a, b, WIDTH), "seg", "id")
    short = o.where(F.col("hi") - F.col("lo") < 9 * S)
    assert ranges.levels_in_use(short, *b, WIDTH) == [0]
    for right in (o, short):
        on_a, on_b = ranges.levels_in_use(s, *a, WIDTH), ranges.levels_in_use(right, *b, WIDTH)
        got = rows(ranges.overlapping(s, right, ["clip_id"], a, b, WIDTH, a_levels=on_a, b_levels=on_b), "seg", "id")
        assert got == (want if right is o else rows(ranges.overlapping(s, short, ["clip_id"], a, b, WIDTH), "seg", "id"))
        assert rows(ranges.overlapping(s, right, ["clip_id"], a, b, WIDTH, b_levels=on_b), "seg", "id") == got
