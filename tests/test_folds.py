"""Folds and boundary edits against plain loops on random timelines, with and without time blocks."""

import random

import pytest

from clipweave.operators import signal as S
from clipweave.operators import timeline as T
from clipweave.operators import tracks as K
from clipweave.plans.ordered import Blocks, Ordered

LABELS = ["N/A", "hold the bolt", "hold the long bolt", "place the nut", "pick up the plate"]


def timeline(seed, clips=6, n=40, contiguous=True):
    rnd = random.Random(seed)
    out = []
    for c in range(clips):
        t = 0
        for i in range(n):
            d = rnd.choice([2, 3, 5, 8, 13, 30])
            out.append((c, i, t, t + d, rnd.choice(LABELS), rnd.choice(LABELS)))
            t += d if contiguous else d - rnd.choice([0, 0, 1, 4])
    return out


def seg_df(spark, rows):
    return spark.createDataFrame(rows, "clip_id long, seg long, start_us long, end_us long, left_label string, right_label string")


def by_clip(rows):
    clips = {}
    for r in rows:
        clips.setdefault(r[0], []).append(list(r))
    return clips


def full(s):
    return sum(x.upper() != "N/A" for x in s[4:6])


BLOCKS = [None, Blocks(60)]


@pytest.mark.parametrize("blocks", BLOCKS)
def test_absorb_tiny(spark, rows, blocks):
    data = timeline(1)
    want = []
    for c, segs in by_clip(data).items():
        again = True
        while again and len(segs) > 1:
            again = False
            for i, s in enumerate(segs):
                if s[3] - s[2] >= 6:
                    continue
                before, after = (segs[i - 1] if i else None), (segs[i + 1] if i + 1 < len(segs) else None)
                if before and (after is None or before[3] - before[2] >= after[3] - after[2]):
                    before[3] = s[3]
                else:
                    after[2] = s[2]
                segs.pop(i)
                again = True
                break
        want += [(c, s[2], s[3], s[4], s[5]) for s in segs]
    got = S.absorb_tiny(seg_df(spark, data), 6, blocks)
    assert rows(got, "clip_id", "start_us", "end_us", "left_label", "right_label") == sorted(want)


@pytest.mark.parametrize("blocks", BLOCKS)
def test_absorb_slivers(spark, rows, blocks):
    data = timeline(2) + [(99, 0, 0, 1, "a", "b"), (99, 1, 1, 3, "c", "d")]
    want = []
    for c, segs in by_clip(data).items():
        again = True
        while again and len(segs) > 1:
            again = False
            for i, s in enumerate(segs):
                if s[3] - s[2] < 6:
                    if i:
                        segs[i - 1][3] = s[3]
                    else:
                        segs[i + 1][2] = s[2]
                    segs.pop(i)
                    again = True
                    break
        want += [(c, s[2], s[3], s[4], s[5]) for s in segs]
    got = T.absorb_slivers(seg_df(spark, data), 6, blocks)
    assert rows(got, "clip_id", "start_us", "end_us", "left_label", "right_label") == sorted(want)


def asks(seed, clips=6, n=25, top=450):
    rnd = random.Random(seed)
    return sorted({(c, rnd.randrange(top)): rnd.choice(["before", "after"]) for c in range(clips) for _ in range(n)}.items())


@pytest.mark.parametrize("blocks", BLOCKS)
@pytest.mark.parametrize("tol", [3, 9])
def test_apply_merges(spark, rows, blocks, tol):
    data, req = timeline(3), asks(4)
    events = [(c, t) for c in range(6) for t in (50, 200, 333)]
    want = []
    for c, segs in by_clip(data).items():
        for t, keep in sorted(((t, k) for (cc, t), k in req if cc == c), reverse=True):
            if any(abs(t - e) <= 5 for cc, e in events if cc == c):
                continue
            for i in range(len(segs) - 1):
                if abs(segs[i][3] - t) < tol:
                    a, b = segs[i], segs[i + 1]
                    src = b if keep == "after" else a
                    a[3], a[4], a[5] = b[3], src[4], src[5]
                    segs.pop(i + 1)
                    break
        want += [(c, s[2], s[3], s[4], s[5]) for s in segs]
    q = spark.createDataFrame([(c, t, k) for (c, t), k in req], "clip_id long, t_us long, keep string")
    ev = spark.createDataFrame(events, "clip_id long, t_us long")
    got = K.apply_merges(seg_df(spark, data), q, ev, tol, 5, 40, blocks)
    assert rows(got, "clip_id", "start_us", "end_us", "left_label", "right_label") == sorted(want)


@pytest.mark.parametrize("blocks", BLOCKS)
def test_apply_seam_merges(spark, rows, blocks):
    tol, pad, data, req = 7, 2, timeline(5), asks(6)
    track = [(c, "left", t, t + 9, "bolt") for c in range(6) for t in range(30, 420, 60)]
    edges = {c: [x for r in track if r[0] == c for x in r[2:4]] for c in range(6)}
    want = []
    for c, segs in by_clip(data).items():
        for t in sorted((t for (cc, t), _ in req if cc == c), reverse=True):
            if abs(t - 100) <= 5:
                continue
            for i in range(len(segs) - 1):
                if abs(segs[i][3] - t) < tol:
                    a, b = segs[i], segs[i + 1]
                    if not any(a[2] + pad < e < b[3] - pad for e in edges[c]):
                        src = a if full(a) >= full(b) else b
                        a[3], a[4], a[5] = b[3], src[4], src[5]
                        segs.pop(i + 1)
                    break
        want += [(c, s[2], s[3], s[4], s[5]) for s in segs]
    q = spark.createDataFrame([(c, t) for (c, t), _ in req], "clip_id long, t_us long")
    ev = spark.createDataFrame([(c, 100) for c in range(6)], "clip_id long, t_us long")
    tr = spark.createDataFrame(track, "clip_id long, hand string, start_us long, end_us long, object string")
    got = K.apply_seam_merges(seg_df(spark, data), q, ev, tr, tol, 5, pad, 40, blocks)
    assert rows(got, "clip_id", "start_us", "end_us", "left_label", "right_label") == sorted(want)


def test_clean_timeline_tiles_the_clip(spark):
    data = timeline(7, contiguous=False)
    clips = spark.createDataFrame([(c, 700) for c in range(7)], "clip_id long, dur_us long")  # clip 6 has no rows
    for blocks in BLOCKS:
        got = T.clean_timeline(seg_df(spark, data), clips, 6, 1, 1, blocks)
        for c in range(7):
            segs = sorted(tuple(r) for r in got.where(f"clip_id = {c}").select("start_us", "end_us").collect())
            assert segs[0][0] == 0 and segs[-1][1] == 700
            assert all(a[1] == b[0] for a, b in zip(segs, segs[1:]))


def test_idempotent(spark, rows):
    data = seg_df(spark, timeline(8))
    cols = ("clip_id", "start_us", "end_us", "left_label", "right_label")
    once = S.absorb_tiny(data, 6)
    assert rows(S.absorb_tiny(once, 6), *cols) == rows(once, *cols)
    m = T.run_length_merge(data, ["left_label", "right_label"])
    assert rows(T.run_length_merge(m, ["left_label", "right_label"]), *cols) == rows(m, *cols)


def test_fuzzy_merge_compares_with_the_first(spark, rows):
    # the second is like the first and the third like the second, but the third is not like the first
    labels = ["hold a b c", "hold a b d", "hold a d e"]
    data = [(1, i, i * 10, i * 10 + 10, l, "N/A") for i, l in enumerate(labels)]
    got = rows(K.fuzzy_merge(seg_df(spark, data), 0.6), "start_us", "end_us", "left_label")
    assert got == [(0, 20, "hold a b c"), (20, 30, "hold a d e")]


@pytest.mark.parametrize("blocks", [None, Blocks(400_000)])
def test_possession_track(spark, rows, blocks):
    # tenths of a second; two empties are flicker, three end the hold
    names = "bolt bolt empty empty bolt bolt bolt empty empty empty bolt bolt bolt bolt nut nut".split()
    rows_in = [(1, "left", i * 100_000, n) for i, n in enumerate(names)]
    rows_in += [(1, "right", t, "cup") for t in (0, 100_000, 200_000)]  # 0.2 s: dropped
    c = spark.createDataFrame(rows_in, "clip_id long, hand string, t_us long, object string")
    got = rows(K.build_track(c, blocks=blocks), "hand", "start_us", "end_us", "object")
    assert got == [("left", 0, 600_000, "bolt"), ("left", 1_000_000, 1_300_000, "bolt")]


def test_snap_gaps_edge(spark, rows):
    t = spark.createDataFrame([(1, "left", 0, 10, "a"), (1, "left", 40, 50, "b"), (1, "left", 81, 90, "c")], "clip_id long, hand string, start_us long, end_us long, object string")
    assert rows(K.snap_gaps(t, 30), "start_us", "end_us") == [(0, 25), (25, 50), (81, 90)]


@pytest.mark.parametrize("kind", ["double", "float", "int", "long", "decimal(12,2)"])
def test_smooth_takes_the_same_types_in_both_plans(spark, kind):
    values = [(c, i * 10, None if i % 7 == 3 or c == 2 else (i * i % 23) * (0.25 if kind in ("double", "float") else 1)) for c in range(3) for i in range(40)]
    df = spark.createDataFrame([(c, t, None if v is None else float(v)) for c, t, v in values], "clip_id long, t_us long, x double")
    df = df.withColumn("x", df.x.cast(kind))
    plain, split = (
        sorted(tuple(r) for r in S.smooth(df, ["x"], 2, Ordered(["clip_id"], ["t_us"], b)).select("clip_id", "t_us", "x_smooth").collect())
        for b in (None, Blocks(70))
    )
    assert plain == split and any(r[2] for r in plain)
