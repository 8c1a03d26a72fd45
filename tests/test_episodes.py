"""Documents written line by line, and tables of parts on one timeline."""

import glob
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from clipweave.operators import chunks
from clipweave.sinks import episodes as E

SEGS = "clip_id long, seg long, start_us long, end_us long, left_label string, right_label string, needs_review int, confidence double"


def documents(spark, heads, sections, partitions=3):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/d"
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    E.write_episode_files(E.episode_lines(heads, sections), path)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    out = {}
    for f in glob.glob(f"{path}/clip_id=*/*.txt"):
        with open(f) as file:
            out.setdefault(f.split("clip_id=")[1].split("/")[0], []).append(json.load(file))
    assert all(len(v) == 1 for v in out.values())
    return {k: v[0] for k, v in out.items()}


@pytest.fixture()
def tables(spark):
    n = 3000
    segs = spark.range(n).selectExpr("1L as clip_id", "id as seg", "id * 1000000 as start_us", "(id + 1) * 1000000 as end_us", "concat('hold \"', id, '\"\\n') as left_label", "if(id = 7, null, 'N/A') as right_label", "int(id = 3) as needs_review", "0.126 as confidence")
    few = spark.createDataFrame([(2, 0, 5_000_000, 9_995_000, "a", "b", None, None)], SEGS)
    lanes = spark.createDataFrame([(1, "left", 0, 2_000_000, "x"), (1, "left", 2_000_000, 3_000_000, "y"), (2, "right", 0, 1, None)], "clip_id long, hand string, start_us long, end_us long, label string")
    flags = spark.createDataFrame([(1, 3, "t", "why"), (1, 99_999, "gone", ""), (2, 0, None, None)], "clip_id long, seg long, type string, detail string")
    qa = spark.createDataFrame([(1, -1, "both", "CLIP", "d"), (1, 2, "left", "C", None)], "clip_id long, seg long, hand string, code string, detail string")
    return segs.unionByName(few), lanes, flags, qa


def test_whole_documents(spark, tables):
    segs, lanes, flags, qa = tables
    heads = spark.createDataFrame([(1, 3_000_000_000, 'a "goal"', 4.5), (2, 0, None, None), (3, 7_000_000, "no rows", None)], "clip_id long, dur_us long, goal string, phase_switch_sec double")
    heads = heads.withColumn("meta", F.struct(F.lit("m").alias("model"), F.col("phase_switch_sec").alias("at")))
    track = spark.createDataFrame([(2, "right", 0, 1_000_000, "cup"), (2, "right", 10_000_000, 11_000_000, "lid"), (2, "right", 9_000_000, 9_500_000, "box")], "clip_id long, hand string, start_us long, end_us long, object string")
    got = documents(spark, heads, [*E.timeline_sections(segs, lanes, flags, qa), E.hand_lists(track, "_track")])
    assert set(got) == {"1", "2", "3"} and all(list(d) == E.KEYS and len(d) == 31 for d in got.values())
    one, two, three = got["1"], got["2"], got["3"]
    assert len(one["segments"]) == 3000 and [s["start_sec"] for s in one["segments"]] == list(map(float, range(3000)))
    assert one["segments"][5] == {"start_sec": 5.0, "end_sec": 6.0, "left": 'hold "5"\n', "right": "N/A", "confidence": 0.13}
    assert one["segments"][7]["right"] is None and [s["needs_review"] for s in one["subtasks"]].index(True) == 3
    assert (one["goal"], one["instruction"], one["phase_switch_sec"], one["meta"]) == ('a "goal"', 'a "goal"', 4.5, {"model": "m", "at": 4.5})
    assert one["_flags"] == [{"seg": 4, "type": "t", "raised_by": None, "detail": "why"}]
    assert [v["seg"] for v in one["_qa"]["violations"]] == [0, 3]
    assert [x["action"] for x in one["left_timeline"]] == ["x", "y"] and one["right_timeline"] == []
    assert [x["interacting_with"] for x in two["_track"]["right"]] == ["cup", "box", "lid"] and two["_track"]["left"] == []
    assert two["segments"][0]["end_sec"] == 10.0 and two["goal"] == "" and two["phase_switch_sec"] is None
    assert three["segments"] == [] and three["_contact_track"] == {"left": [], "right": []} and three["environment"] == {"category": ""}
    assert three["duration_sec"] == 7.0 and three["override_applied"] is False


def test_no_clips_no_documents(spark, tables):
    heads = spark.createDataFrame([], "clip_id long, dur_us long")
    assert E.episode_lines(heads, [s.limit(0) for s in E.timeline_sections(*tables)]).count() == 0


def test_parts_move_times_and_numbers(spark, rows):
    t = lambda data, ddl: spark.createDataFrame(data, ddl)
    parts = t([(1, 0, 0), (1, 1, 100), (1, 2, 250)], "clip_id long, part long, off_us long")
    tables = {
        "segments": t([(1, 0, 0, 0, 50, "a"), (1, 0, 1, 50, 100, "b"), (1, 2, 0, 0, 30, "c")], "clip_id long, part long, seg long, start_us long, end_us long, label string"),
        "flags": t([(1, 0, 1, "f"), (1, 2, 0, "g"), (1, 1, -1, "empty part")], "clip_id long, part long, seg long, type string"),
        "qa": t([(1, 2, -1, "whole"), (1, 2, 0, "one"), (1, 2, None, "none")], "clip_id long, part long, seg long, code string"),
        "transitions": t([(1, 1, 5, "x"), (1, 2, 7, "y")], "clip_id long, part long, t_us long, kind string"),
        "track": t([(1, 2, "left", 1, 2, "cup")], "clip_id long, part long, hand string, start_us long, end_us long, object string"),
    }
    got = chunks.merge_part_tables(tables, parts)
    assert rows(got["segments"], "seg", "start_us", "end_us", "label") == [(0, 0, 50, "a"), (1, 50, 100, "b"), (2, 250, 280, "c")]
    assert rows(got["flags"], "seg", "type") == [(-1, "empty part"), (1, "f"), (2, "g")]
    assert {(r.seg, r.code) for r in got["qa"].collect()} == {(-1, "whole"), (2, "one"), (None, "none")}
    assert rows(got["transitions"], "t_us", "kind") == [(105, "x"), (257, "y")]
    assert rows(got["track"], "start_us", "end_us", "object") == [(251, 252, "cup")] and "part" not in got["track"].columns


def test_many_documents_share_a_file(spark, tables):
    """One document a line: files do not grow in number with the clips, and documents are those of a file a clip."""
    segs, lanes, flags, qa = tables
    heads = spark.range(1, 301).selectExpr("id as clip_id", "id * 1000000 as dur_us", "concat('goal\n\"override_applied\": ', id) as goal")
    lines = E.episode_lines(heads, E.timeline_sections(segs, lanes, flags, qa))
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/d"
    E.write_episode_lines(lines, path)
    files = glob.glob(f"{path}/*.txt")
    assert len(files) <= 8
    got = {}
    for f in files:
        with open(f) as file:
            got.update({d["clip"]: d for d in map(json.loads, filter(str.strip, file))})
    assert got == documents(spark, heads, E.timeline_sections(segs, lanes, flags, qa)) and len(got) == 300
    back = E.read_episode_files(spark, path, "clip string, goal string, segments array<struct<start_sec: double>>", lines=True)
    assert {(r.clip, r.goal, len(r.segments)) for r in back.collect()} == {(k, d["goal"], len(d["segments"])) for k, d in got.items()}
