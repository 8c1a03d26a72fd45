"""Containment by grams, names snapped to a vocabulary, logs read in ranges, ties in input order."""

import random

import pytest
from pyspark.sql import functions as F

from clipweave.operators import joins, timeline, voting
from clipweave.plans.containment import containment
from clipweave.sources import readers


@pytest.mark.parametrize("seed", [1, 2])
def test_containment_matches_all_pairs(spark, rows, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    needles = [(rng.choice("xy"), word(rng.randint(0, 5))) for _ in range(60)] + [("x", None)]
    hays = [(rng.choice("xy"), word(rng.randint(0, 12))) for _ in range(40)] + [("y", None)]
    n = spark.createDataFrame(needles, "k string, needle string")
    h = spark.createDataFrame(hays, "k string, hay string")
    want = {(k, a, b) for k, a in needles for j, b in hays if k == j and a and b and a in b}
    assert set(rows(containment(n, h, ["k"]), "k", "needle", "hay")) == want and want
    assert set(rows(containment(n, h), "needle", "hay")) == {(a, b) for _, a in needles for _, b in hays if a and b and a in b}


def plain_snap(name, known):
    low = [k.lower() for k in known]
    if (name or "").upper() in ("N/A", "NA", ""):
        return "N/A"
    if not known:
        return name
    if name.lower() in low:
        return known[len(low) - 1 - low[::-1].index(name.lower())]
    if any(k in name.lower() for k in low):
        return name
    return next((known[i] for i, k in enumerate(low) if name.lower() in k), "N/A")


def test_snapping_matches_the_plain_rule(spark):
    known = {1: ["Red Cup", "cup", "red cup", "steel bolt M4"], 2: ["", "lid"], 3: []}
    names = ["RED CUP", "big cup here", "bolt", "M", "zzz", None, "n/a", "", "lid", "id", "Cup"]
    vocab = spark.createDataFrame([(c, i, k) for c, ks in known.items() for i, k in enumerate(ks)], "clip_id long, ord long, name string")
    pred = spark.createDataFrame([(c, n, "kept") for c in known for n in names], "clip_id long, name string, low string")
    got = {(r.clip_id, r.name): r.snapped for r in joins.snap_vocab(pred, vocab).collect()}
    assert got == {(c, n): plain_snap(n, ks) for c, ks in known.items() for n in names}
    assert joins.snap_vocab(pred, vocab).columns == ["clip_id", "name", "low", "snapped"]


def test_ranks_over_steps(spark):
    rng = random.Random(4)
    data = [(rng.choice([1, 2]), rng.randint(0, 5000), o, rng.choice(["Cup", "cup ", "lid", "a", "b", "c", "d", " ", "E"])) for _ in range(60) for o in (0, 1)]
    data += [(1, f, 9, f"rare {f}") for f in range(0, 5000, 500)]
    got = voting.inventory_votes(spark.createDataFrame(data, "clip_id long, frame long, ord long, name string"))
    for clip in (1, 2):
        first, frames = {}, {}
        for c, f, o, name in data:
            if c == clip and name.strip():
                k = name.strip().lower()
                frames.setdefault(k, set()).add(f)
                first[k] = min(first.get(k, (f, o)), (f, o))
        want = sorted(frames, key=lambda k: (-len(frames[k]), first[k]))
        ranks = {r["rank"]: (len(frames[r.key]), first[r.key]) for r in got.where(F.col("clip_id") == clip).collect()}
        assert [ranks[i + 1] for i in range(len(want))] == [(len(frames[k]), first[k]) for k in want]


def test_logs_are_numbered_across_byte_ranges(spark, tmp_path):
    lines = {"a.log": [f"line {i} " + "x" * (i % 50) for i in range(2000)], "b.log": ["", "one\r", "", "last"]}
    for name, ls in lines.items():
        with open(tmp_path / name, "w", newline="") as f:
            f.write("\n".join(ls))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = readers.read_logs(spark, f"{tmp_path}/*.log")
        assert spark.read.text(f"{tmp_path}/a.log").rdd.getNumPartitions() > 5
        got = df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, ls in lines.items():
        assert [r.line for r in sorted((r for r in got if r.file == name), key=lambda r: r.pos)] == [x.rstrip("\r") for x in ls]
        assert sorted(r.pos for r in got if r.file == name) == list(range(len(ls)))


def test_rows_that_start_together_keep_input_order(spark, rows):
    raw = spark.createDataFrame([(1, 0, 90, "long", 0), (1, 0, 50, "short", 1), (1, 60, 100, "x", 2)], "clip_id long, start_us long, end_us long, left_label string, ord long").withColumn("right_label", F.lit("N/A"))
    assert rows(timeline.deoverlap(raw, 5), "start_us", "end_us", "left_label") == [(0, 90, "long"), (90, 100, "x")]
    assert rows(timeline.deoverlap(raw.drop("ord"), 5), "start_us", "end_us", "left_label") == [(0, 50, "short"), (50, 90, "long"), (90, 100, "x")]


@pytest.mark.parametrize("few, many", [(64, 16_384), (6, 16_384), (64, 8), (0, 0)])
def test_containment_of_keys_with_few_and_with_many_texts(spark, rows, monkeypatch, few, many):
    from clipweave.plans import containment as module

    monkeypatch.setattr(module, "FEW", few, raising=False)
    monkeypatch.setattr(module, "MANY", many, raising=False)
    rng = random.Random(few + many)
    word = lambda: "".join(rng.choice("ab c") for _ in range(rng.randint(0, 6)))
    texts = lambda n: [(k, word()) for k in "xyz" for _ in range(n * (1 + 4 * (k == "z")))] + [("x", None), (None, "a"), ("only", "b")]
    needles, hays = texts(4), texts(6)
    n, h = spark.createDataFrame(needles, "k string, needle string"), spark.createDataFrame(hays, "k string, hay string")
    got = containment(n, h, ["k"])
    want = {(k, a, b) for k, a in needles for c, b in hays if k is not None and k == c and a and b and a in b}
    assert rows(got, "k", "needle", "hay") == sorted(want) and want
    if few == 64 and many > 8:  # no grams where all keys have few texts
        assert "sequence(" not in got._jdf.queryExecution().optimizedPlan().toString()
