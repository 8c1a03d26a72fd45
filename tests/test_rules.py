"""Hand-made cases for text rules, QA, votes and evaluation."""

import pytest
from pyspark.sql import functions as F

from clipweave.functions import geometry as G
from clipweave.functions import text as X
from clipweave.operators import analysis as A
from clipweave.operators import answers as N
from clipweave.operators import chunks as C
from clipweave.operators import evaluation as E
from clipweave.operators import grounding as D
from clipweave.operators import joins as J
from clipweave.operators import qa as Q
from clipweave.operators import signal as S
from clipweave.operators import timeline as T
from clipweave.operators import voting as V
from clipweave.schemas import ANSWERS

SEC = 1_000_000


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("unscrew the cap", "DISASSEMBLY"), ("counter-clockwise", "DISASSEMBLY"), ("counter clockwise", "ASSEMBLY"), ("anticlockwise", None),
        ("clockwise", "ASSEMBLY"), ("insert and extract", None), ("cannot determine, clockwise", None), ("disassembly", "DISASSEMBLY"), ("", None),
    ],
)
def test_direction(spark, text, want):
    assert one(spark, X.direction_class(F.lit(text))) == want


@pytest.mark.parametrize("text, want", [("both hands", "both_active"), ("left", "actor=left"), ("r", "actor=right"), ("left and right", None), ("unclear", None)])
def test_role(spark, text, want):
    assert one(spark, X.role_class(F.lit(text))) == want


@pytest.mark.parametrize("text, want", [("a red one", "red"), ("blue and white", "mixed"), ("assorted", "mixed"), ("unclear", None), ("plain", None)])
def test_colour(spark, text, want):
    assert one(spark, X.colour_class(F.lit(text))) == want


def test_empty_words_differ(spark):
    hits = {n: one(spark, X.is_empty(F.lit(" Nothing "), n)) for n in X.EMPTY_WORDS}
    assert hits == {"track": True, "analysis": False, "contact": True, "consistency": False, "onepass": False, "caption": True, "vote": True}


@pytest.mark.parametrize("label, d, want", [("unthread the nut", "screw", True), ("unfasten it", "screw", False), ("unfasten it", "unscrew", False), ("unscrew it", "unscrew", True), ("screw it", "unscrew", False)])
def test_rotation_verbs(spark, label, d, want):
    assert one(spark, X.rotation_agrees(F.lit(label), F.lit(d))) is want


def test_fence_and_fixed_point_text(spark):
    assert one(spark, X.strip_code_fence(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, X.seconds_text(F.lit(12_345_678))) == "12.3"
    assert one(spark, X.seconds_text(F.lit(2_675_000), 2)) == "2.68"


def segs(spark, data):
    return spark.createDataFrame(data, "clip_id long, seg long, start_us long, end_us long, left_label string, right_label string")


def test_qa_quartet(spark, rows):
    from clipweave.operators.hands import unpivot_hands

    s = segs(spark, [
        (1, 0, 0, 2 * SEC, "N/A", "insert the bolt"),
        (1, 1, 2 * SEC, 4 * SEC, "pick up and place the nut", "N/A"),
        (1, 2, 4 * SEC, 6 * SEC, "twist the cap", "twist the caps"),
        (1, 3, 6 * SEC, 8 * SEC, "disassemble the unit", "disassemble the unit"),
    ])
    tr = spark.createDataFrame([(1, "left", 0, 19 * SEC // 10, "bolt"), (1, "left", 2 * SEC, 8 * SEC, "screw")], "clip_id long, hand string, start_us long, end_us long, object string")
    h = unpivot_hands(s)
    assert rows(Q.contact_qa(tr, h), "seg", "hand", "code") == [
        (0, "left", "NA-WHILE-TRACKED"), (0, "right", "ACTION-WHILE-UNTRACKED"), (2, "right", "ACTION-WHILE-UNTRACKED"), (3, "right", "ACTION-WHILE-UNTRACKED")
    ]
    # a label with a release and a pick verb is judged as a release: at its start, where bolt and screw are near
    assert rows(Q.track_consistency(tr, h), "seg", "hand", "detail") == [(1, "left", "bolt")]
    assert rows(Q.pair_exclusivity(s), "seg", "detail") == [(2, "twist")]
    # "disassemble" holds "assemble", and that is how it is counted here
    assert rows(Q.direction_counts(h), "asm", "dis") == [(3, 0)]


def test_runs_and_recheck(spark, rows):
    seq = "A A D A A D D".split()
    pts = spark.createDataFrame([(1, i, {"A": "ASSEMBLY", "D": "DISASSEMBLY"}[x]) for i, x in enumerate(seq)] + [(2, 0, None)], "clip_id long, t_us long, direction string")
    runs = T.direction_runs(pts)
    assert rows(T.recheck_times(runs), "clip_id", "t_us") == [(1, 2)]
    clips = spark.createDataFrame([(1,), (2,)], "clip_id long")
    assert rows(T.direction_summary(pts, runs, clips), "clip_id", "assembly", "disassembly", "majority", "runs", "rule") == [
        (1, 4, 3, "assembly", 4, "mixed_eligible"), (2, 0, 0, "none", 0, "no_decisive_rotation")
    ]


def test_vote_ties_go_to_the_earliest_run(spark, rows):
    r = spark.createDataFrame([(1, "left", 0, 0, "bolt"), (1, "left", 1, 0, "nut"), (1, "left", 0, 1, "N/A"), (1, "left", 1, 1, "the silver nut")], "clip_id long, hand string, run long, t_us long, name string")
    assert rows(V.consensus(r), "idx", "object") == [(0, "bolt"), (1, "empty")]


def test_greedy_match_takes_the_first_not_the_nearest(spark, rows):
    t = spark.createDataFrame([(1, 10), (1, 12)], "clip_id long, t_us long")
    d = spark.createDataFrame([(1, 8), (1, 10), (1, 30)], "clip_id long, t_us long")
    assert rows(E.greedy_match(t, d, 3), "t_us", "det_us") == [(10, 8), (12, 10)]


def test_midpoint_alignment_falls_back_to_nearest(spark, rows):
    t = segs(spark, [(1, 0, 100, 200, "a", "b")])
    p = segs(spark, [(1, 0, 0, 100, "a", "b"), (1, 1, 220, 230, "a", "b")])
    assert rows(J.align_by_midpoint(t, p, 1, 50), "seg", "pred_seg", "how") == [(0, 1, "nearest")]


@pytest.mark.parametrize("n_old, n_new, dur, source", [(5, 2, 10, "original"), (5, 3, 10, "rewrite"), (4, 1, 6, "rewrite"), (4, 1, 7, "original"), (9, 0, 5, "original")])
def test_degenerate_rewrite(spark, n_old, n_new, dur, source):
    mk = lambda n: segs(spark, [(1, i, i, i + 1, "a", "b") for i in range(n)] + [(2, 0, 0, 1, "x", "y")])
    clips = spark.createDataFrame([(1, dur * SEC), (2, SEC)], "clip_id long, dur_us long")
    got = T.guard_rewrite(mk(n_old), mk(n_new), clips).where("clip_id = 1").select("source").distinct().collect()
    assert [r[0] for r in got] == [source]


def test_accuracy_ignores_unjudged(spark, rows):
    s = spark.createDataFrame([(1, 1, "a"), (1, 0, "N/A"), (1, None, "b"), (2, None, "c")], "clip_id long, match int, pred string")
    got = {r["clip_id"]: (r["slots"], r["matched"], r["na_misses"], r["acc"]) for r in E.identity_accuracy(s).collect()}
    assert got == {1: (2, 1, 1, 0.5), 2: (0, 0, 0, 0.0), None: (2, 1, 1, 0.5)}


def test_seam_with_single_segment_part(spark, rows):
    # the middle part is one segment, the right side of one seam and the left side of the next
    s = segs(spark, [(1, 0, 0, 10 * SEC, "a", ""), (1, 1, 10 * SEC, 20 * SEC, "b", ""), (1, 2, 20 * SEC, 30 * SEC, "c", ""), (1, 3, 30 * SEC, 40 * SEC, "d", "")])
    seams = spark.createDataFrame([(1, 10 * SEC), (1, 20 * SEC)], "clip_id long, t_us long")
    j = C.seam_jobs(s, seams)
    assert rows(j, "li", "ri", "a_us", "b_us", "n_seams") == [(0, 2, 0, 30 * SEC, 2)]
    new = spark.createDataFrame([(1, 1, 0, 30 * SEC, "one", "")], "clip_id long, job long, start_us long, end_us long, left_label string, right_label string")
    assert rows(C.splice_seams(s, j, new), "seg", "start_us", "left_label") == [(0, 0, "one"), (1, 30 * SEC, "d")]


def test_bursts_split_and_tile(spark, rows):
    e = [0, 9, 9, 9, 9, 1, 9, 9, 9, 9, 0, 0, 0]
    en = spark.createDataFrame([(1, i * 200_000, x) for i, x in enumerate(e)], "clip_id long, t_us long, energy long")
    b = spark.createDataFrame([(1, 200_000, 1_800_000)], "clip_id long, start_us long, end_us long")
    sp = S.split_bursts(b, en)
    assert rows(sp, "start_us", "end_us") == [(200_000, 1_000_000), (1_000_000, 1_800_000)]
    clips = spark.createDataFrame([(1, 1_840_000), (2, SEC)], "clip_id long, dur_us long")
    assert rows(S.tile_spans(sp, clips), "clip_id", "start_us", "end_us", "type") == [
        (1, 0, 1_000_000, "transition"), (1, 1_000_000, 1_840_000, "transition"), (2, 0, SEC, "action")
    ]


def test_vocabulary_snap(spark, rows):
    v = spark.createDataFrame([(1, 0, "Cup"), (1, 1, "Blue Bolt")], "clip_id long, ord long, name string")
    p = spark.createDataFrame([(1, n) for n in ("cup", "cup with beads", "bolt", "hammer", "n/a")], "clip_id long, name string")
    assert rows(J.snap_vocab(p, v), "name", "snapped") == [("bolt", "Blue Bolt"), ("cup", "Cup"), ("cup with beads", "cup with beads"), ("hammer", "N/A"), ("n/a", "N/A")]


def test_temporal_carry_respects_a_certain_gate(spark, rows):
    cols = "clip_id long, seg_id string, t_us long, primary int, obj int, name string, conf int, src string, gate int, q1 int, q2 int"
    mk = lambda sid, g, q: [(1, sid, 10, 1, 0, "N/A", 0, "", g, q, 0), (1, sid, 12, 0, 1, "cup", 80, "llm", 1, 1, 1)]
    got = rows(D.temporal_carry(spark.createDataFrame(mk("s0L", 0, 0) + mk("s1L", 0, 1), cols)), "seg_id", "name", "src")
    assert got == [("s0L", "N/A", ""), ("s1L", "cup", "temporal")]


def test_every_clip_has_its_role_probe(spark, rows):
    clips = spark.createDataFrame([(1, 60 * SEC), (2, 120 * SEC)], "clip_id long, dur_us long")
    spans = spark.createDataFrame([(1, 0, SEC), (2, 0, SEC)], "clip_id long, start_us long, end_us long")
    p = V.plan_probes(clips, spans).groupBy("clip_id", "kind").count()
    assert rows(p, "clip_id", "kind", "count") == [(1, "direction", 10), (1, "role", 1), (2, "direction", 20), (2, "role", 1)]


def test_keypoint_geometry(spark):
    kp = [(float(i), float(2 * i), 0.9) for i in range(21)]
    df = spark.createDataFrame([(kp,), ([(0.0, 0.0, 0.1)] * 21,)], "kp array<struct<x: double, y: double, conf: double>>")
    box = [F.lit(float(x)) for x in (0, 0, 30, 40)]
    r = df.select(G.grip_ratio(F.col("kp"), box).alias("g"), G.pinch_point(F.col("kp"), box).alias("p"), F.size(G.expand_from_wrist(F.col("kp"), 0.2)).alias("n"), G.expand_from_wrist(F.col("kp"), 0.5).alias("e")).collect()
    assert abs(r[0]["g"] - (16**2 + 32**2) ** 0.5 / 50) < 1e-12 and r[1]["g"] is None
    assert (r[0]["p"]["x"], r[0]["p"]["y"]) == (9.0, 18.0) and (r[1]["p"]["x"], r[1]["p"]["y"]) == (15.0, 20.0)
    assert r[0]["n"] == 21 and tuple(r[0]["e"][2]) == (3, 6) and r[1]["e"] is None


def test_band_fraction(spark):
    cells = [(0, 0), (10, 0), (5, 9), (5, 11), (40, 0)]
    df = spark.createDataFrame([([(float(a), float(b)) for a, b in cells],)], "c array<struct<x: double, y: double>>")
    z = [F.lit(0.0), F.lit(0.0)], [F.lit(10.0), F.lit(0.0)]
    assert df.select(G.band_fraction(F.col("c"), *z)).first()[0] == 0.6


def test_answers(spark):
    docs = ['{"events": [{"t": 1, "hand": "left", "kind": "place", "object": "x", "evidence": "y"}]}', '{"events": [{"t": 1, "hand": "foot", "kind": "place", "object": "x", "evidence": "y"}]}', '{"events": [{"t": 1}]}', "{}", "nonsense", "[1]"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, raw string")
    got = [r["problem"] for r in N.check_answer(df, "raw", ANSWERS["transitions"]).orderBy("i").collect()]
    assert got == [None, "value of events.hand not allowed", "incomplete item in events", "missing events", "not a JSON object", "not a JSON object"]
    ok, bad = N.split_answers(N.check_answer(df, "raw", ANSWERS["transitions"]))
    assert (ok.count(), bad.count()) == (1, 5)


def test_frozen_label_is_flagged(spark, rows):
    s = segs(spark, [(1, 0, 0, 5 * SEC, "hold the bolt", "N/A"), (1, 1, 5 * SEC, 9 * SEC, "hold the bolt", "N/A")])
    ev = spark.createDataFrame([(1, 5 * SEC + 300_000, "left", "place")], "clip_id long, t_us long, hand string, kind string")
    assert rows(A.frozen_across(s, ev), "seg", "hand") == [(1, "left")]
    assert rows(A.dup_across(s, ev), "seg") == [(1,)]


def test_equal_points_stay_apart(spark, rows):
    s = segs(spark, [(1, 0, 0, 100, "a", "b"), (1, 1, 100, 200, "a", "b")])
    ev = spark.createDataFrame([(1, 150), (1, 150), (2, 5)], "clip_id long, t_us long")
    assert rows(J.label_at(ev, s, "closed"), "clip_id", "t_us", "seg") == [(1, 150, 1), (1, 150, 1), (2, 5, None)]
    assert rows(J.owner_segment(ev, s, 0), "clip_id", "seg") == [(1, 1), (1, 1), (2, 0)]


def test_best_view_is_per_clip(spark, rows):
    c = spark.createDataFrame([(1, "cup", 0, 0, 5, [1]), (2, "cup", 3, 1, 9, [1])], "clip_id long, name string, frame long, cand long, score long, mask array<long>")
    assert rows(D.best_view(c, 33), "clip_id", "frame") == [(1, 0), (2, 3)]


def test_clip_findings_reach_the_document(spark):
    from clipweave.sinks import writers as K

    s = segs(spark, [(1, 0, 0, SEC, "a", "b")]).withColumn("needs_review", F.lit(0))
    lanes = spark.createDataFrame([(1, "left", 0, SEC, "a")], "clip_id long, hand string, start_us long, end_us long, label string")
    flags = spark.createDataFrame([], "clip_id long, seg long, type string")
    qa = spark.createDataFrame([(1, -1, "both", "DIRECTION-CONFLICT", "assembly")], "clip_id long, seg long, hand string, code string, detail string")
    clips = spark.createDataFrame([(1, SEC)], "clip_id long, dur_us long")
    doc = K.assemble_episodes(s, lanes, flags, qa, clips).first()
    assert [(q.seg, q.code) for q in doc["_qa"].violations] == [(0, "DIRECTION-CONFLICT")]


def test_sequence_review_sorts_once(spark, rows):
    """One order of the segments serves all findings: a task sorts and groups its rows once, not seven times."""
    labels = ["hold a"] * 4 + ["put b"] * 3 + [None, "n/a", "N/A ", "n/a"] + ["pick up c", "put c", "put c"]
    data = [(1, i, i * 10, i * 10 + 10, l, f"hold {i}" if i else None) for i, l in enumerate(labels)]
    segs = spark.createDataFrame(data, "clip_id long, seg long, start_us long, end_us long, left_label string, right_label string")
    got = A.sequence_review(segs)
    assert [r for r in rows(got, "seg", "hand", "type") if r[2] == "long_run?"] == [(0, "left", "long_run?"), (7, "left", "long_run?")]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert got._jdf.queryExecution().executedPlan().toString().count("Sort [") <= 1 and "HashAggregate" not in plan


def test_direction_points_search_a_text_once(spark):
    texts = ["unscrew the cap", "counter clockwise", "anticlockwise", "cannot determine, clockwise", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "t_us long, verdict string")
    got = X.direction_points(df, "verdict", "t_us").where(F.col("direction").isNotNull())
    assert sorted(map(tuple, got.collect())) == [(0, "DISASSEMBLY"), (1, "ASSEMBLY")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("assembling") <= df.select(X.direction_class("verdict"))._jdf.queryExecution().optimizedPlan().toString().count("assembling")
    assert not any("lower(" in line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter"))


def test_violations_work_speeds_out_once(spark, monkeypatch):
    from clipweave import catalog

    calls, speed = [], S.hand_speed
    monkeypatch.setattr(S, "hand_speed", lambda *a, **kw: calls.append(1) or speed(*a, **kw))
    catalog.SPARK["contract_violations"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_robust_frame_medians_are_sorted_without_a_comparator(spark):
    rng = __import__("random").Random(3)
    value = lambda: rng.choice([None, 0, 10, 40, 70])
    sig = [("a", rng.choice(["left", "right"]), i, i * 10, value(), value(), value(), value(), value(), value(), value()) for i in range(60)]
    out = S.robust_frame(spark.createDataFrame(sig, "clip_id string, hand string, frame long, t_us long, x long, y long, grip long, tx long, ty long, ix long, iy long"), 3, 30, 20, 45)
    want = {}
    for h in ("left", "right"):
        rows = [r for r in sig if r[1] == h]
        for i, r in enumerate(rows):
            near = [w for w in rows[max(0, i - 3) : i + 4] if w[4] is not None]
            tips = [w for w in near if None not in w[7:]]

            def median(k, of):
                v = sorted((w[k] for w in of), key=lambda x: (x is None, x or 0))  # missing values last
                a, b = (v[(len(v) - 1) // 2], v[len(v) // 2]) if v else (None, None)
                return None if a is None or b is None else (a + b) / 2

            m = {4: median(4, near), 5: median(5, near), 6: median(6, [w for w in near if w[6] is not None])} | {k: median(k, tips) for k in (7, 8, 9, 10)}
            far = lambda w, a, b: None if None in (w[a], w[b], m[a], m[b]) else (w[a] - m[a]) ** 2 + (w[b] - m[b]) ** 2
            close = lambda w, a, b, d: far(w, a, b) is not None and far(w, a, b) <= d * d
            up = lambda w: w[6] is not None and m[6] is not None and w[6] > m[6] + 20
            good = [(abs(w[2] - r[2]), w[2]) for w in tips if close(w, 4, 5, 30) and not up(w) and close(w, 7, 8, 45) and close(w, 9, 10, 45)]
            want[r[2]] = min(good)[1] if good else r[2]
    assert {r.frame: r.use_frame for r in out.collect()} == want and any(k != f for k, f in want.items())
    assert "array_sort(" not in out._jdf.queryExecution().optimizedPlan().toString().replace("sort_array(", "")


def test_run_qa_sends_rows_to_the_levels_in_use_only(spark, monkeypatch):
    from clipweave import catalog

    used, join = [], Q.overlapping
    monkeypatch.setattr(Q, "overlapping", lambda *a, **kw: used.append((kw.get("a_levels"), kw.get("b_levels"))) or join(*a, **kw))
    for name in ("run_qa", "contact_findings", "track_consistency"):
        catalog.SPARK[name](spark, "/root/testdata/sf0.001")
    assert used == [([0], [0])] * 3
