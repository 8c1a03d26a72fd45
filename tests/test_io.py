"""Readers and writers on small files."""

import json
import tempfile
import os

from pyspark.sql import functions as F

from clipweave.operators import timeline as T
from clipweave.operators.joins import contact_pairs
from clipweave.sinks import writers as K
from clipweave.sources import readers as R


def put(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(text)
    return str(path)


def test_episode_round_trip(spark, rows, tmp_path):
    s = spark.createDataFrame([("c", 0, 0, 2_500_000, "hold a", "N/A", 0), ("c", 1, 2_500_000, 4_000_000, "hold a", "put b", 1)],
                              "clip_id string, seg long, start_us long, end_us long, left_label string, right_label string, needs_review int")
    from clipweave.operators.hands import unpivot_hands

    lanes = T.run_length_merge(unpivot_hands(s.drop("needs_review")), ["label"], ["clip_id", "hand"])
    flags = spark.createDataFrame([("c", 1, "chained_narrative?")], "clip_id string, seg long, type string")
    qa = spark.createDataFrame([("c", 1, "right", "CODE", "why")], "clip_id string, seg long, hand string, code string, detail string")
    clips = spark.createDataFrame([("c", 4_000_000)], "clip_id string, dur_us long")
    path = str(tmp_path / "ep")
    K.write_episodes(K.assemble_episodes(s, lanes, flags, qa, clips), path)
    ep = R.read_episodes(spark, path)
    back = R.episode_segments(ep)
    assert rows(back, "clip_id", "seg", "start_us", "end_us", "left_label", "right_label") == [("c", 0, 0, 2_500_000, "hold a", "N/A"), ("c", 1, 2_500_000, 4_000_000, "hold a", "put b")]
    d = K.to_legacy(ep).first()
    assert d["instruction"] == "" and d["environment"]["category"] == "" and d["meta"]["duration_sec"] == 4.0
    assert [x["needs_review"] for x in d["subtasks"]] == [False, True]
    assert len(ep.first()["left_timeline"]) == 1 and len(ep.first()["right_timeline"]) == 2


def test_missing_keys(spark, rows, tmp_path):
    p = put(f"{tmp_path}/a.json", json.dumps({"clip": "x", "segments": [{"start_sec": 1, "end_sec": 2, "left": "a"}]}))
    assert rows(R.read_overrides(spark, p), "clip_id", "start_us", "left_label", "right_label") == [("x", 1_000_000, "a", "N/A")]


def test_index_prompts_inventory(spark, rows, tmp_path):
    a = put(f"{tmp_path}/run1/index_a.json", json.dumps([{"tag": "a", "hand": "L", "t": 1.5, "obj": True, "name": "cup"}]))
    b = put(f"{tmp_path}/run2/index_b.json", json.dumps([{"tag": "b", "hand": "R", "t": 2.0, "obj": False}]))
    assert rows(R.read_index(spark, [a, b]), "folder", "tag", "t_us", "obj") == [("run1", "a", 1_500_000, True), ("run2", "b", 2_000_000, False)]
    p = put(f"{tmp_path}/p.json", json.dumps({"video": "v", "W": 9, "H": 8, "fps": 10, "prompts": [{"t": 1.25, "hand": "L", "box_px": [1, 2, 3, 4]}]}))
    assert rows(R.read_prompts(spark, p), "video", "t_ms", "hand", "W") == [("v", 1250, "L", 9)]
    i = put(f"{tmp_path}/i.json", json.dumps({"tag": "a", "objects": ["cup", {"name": "table", "role": "fixture"}]}))
    assert rows(R.read_inventory(spark, i), "tag", "name", "role") == [("a", "cup", "manipulable"), ("a", "table", "fixture")]


def test_manifest_logs_ledger(spark, rows, tmp_path):
    m = put(f"{tmp_path}/m.txt", "ds1 clipA\n\n  ds2   clipB\n")
    assert rows(R.read_manifest(spark, m), "dataset", "clip") == [("ds1", "clipA"), ("ds2", "clipB")]
    mj = put(f"{tmp_path}/m.json", json.dumps([{"dataset": "d", "name": "n", "frames": "f"}]))
    assert rows(R.read_manifest_json(spark, mj), "dataset", "name", "ann") == [("d", "n", None)]
    log = "[10:00:00] annotate x (12.5s)\n[10:00:01] TRACE [1A seed 1] (1 segs)\n   #1 old\n[10:00:02] note\n[10:00:03] TRACE [1A seed 2] (2 segs)\n   #1 a\n   #2 b\n[10:00:04] end: 3 grounded\n"
    put(f"{tmp_path}/logs/c1.console.log", log)
    put(f"{tmp_path}/logs/c_batch.console.log", log)
    lines = R.read_logs(spark, f"{tmp_path}/logs/*.log")
    blocks = R.extract_blocks(lines)
    assert [r[1].strip() for r in sorted((r["pos"], r["line"]) for r in blocks.collect())][1:] == ["#1 a", "#2 b"]
    assert {r["file"] for r in blocks.collect()} == {"c1.console.log"}
    assert rows(R.log_tally(lines, r"#\d"), "file", "n", "last") == [("c1.console.log", 3, "   #2 b")]
    assert K.log_report(blocks).first()["rows"] == 2
    from clipweave.functions import text as X

    assert [r[0] for r in lines.select(X.annotate_seconds("line").alias("s")).where("s is not null").collect()] == ["12.5"]
    led = str(tmp_path / "ledger")
    for n in (1, 2):
        K.append_ledger(spark.createDataFrame([("f", n, 10 * n, n)], "family string, calls long, prompt_tokens long, completion_tokens long"), led)
    assert rows(K.usage_summary(R.read_ledger(spark, led)), "family", "calls", "prompt_tokens") == [("f", 3, 30)]


def test_frames_and_signals(spark, rows, tmp_path):
    put(f"{tmp_path}/f/frame_0012.jpg", b"\xff\xd8" + b"0" * 200, "wb")
    put(f"{tmp_path}/f/frame_0003.jpg", b"\xff\xd8" + b"0" * 10, "wb")
    put(f"{tmp_path}/f/frame_0004.jpg", b"xx" + b"0" * 200, "wb")
    assert rows(R.scan_frames(spark, f"{tmp_path}/f/*.jpg"), "frame", "length") == [(12, 202)]
    nan = float("nan")
    sig = spark.createDataFrame([("c", "left", [0.0, 0.1], [0.5, nan], [nan, 0.2], [1.0, 0.0])], "clip_id string, hand string, t array<double>, cx array<double>, grip array<double>, pres array<double>").withColumn("cy", F.col("cx"))
    sig.write.parquet(f"{tmp_path}/sig")
    assert sorted(((r["frame"], r["cx"], r["grip"]) for r in R.read_signals(spark, f"{tmp_path}/sig").collect()), key=lambda x: x[0]) == [(0, 0.5, None), (1, None, 0.2)]


def test_annotations(spark, rows, tmp_path):
    k = put(f"{tmp_path}/k.json", json.dumps({"a.jpg": [{"cls": 0, "conf": 0.9, "box": [1, 2, 3, 4], "kpts": [[1, 2, 0.5]]}, {"cls": 1}], "b.jpg": []}))
    assert rows(R.read_keypoints(spark, k), "file", "hand_id", "cls") == [("a.jpg", 0, 0), ("a.jpg", 1, 1)]
    doc = {"video_annotations": [{"image": {"name": "f1"}, "annotations": [{"id": "h", "name": "left hand", "in_contact_object": "o"}, {"id": "o", "name": "cup"}, {"id": "r", "name": "right hand", "in_contact_object": "gone"}]}]}
    c = R.read_contact_annotations(spark, put(f"{tmp_path}/c.json", json.dumps(doc)))
    assert sorted((r["entity"], r["object"]) for r in contact_pairs(c).collect()) == [("h", "cup"), ("r", None)]
    doc = {"videos": [{"id": 1, "video_name": "v", "file_names": ["a", "b"]}], "annotations": [{"video_id": 1, "noun_phrase": "left hand", "segmentations": ["x", "y"]}, {"video_id": 1, "noun_phrase": "cup", "segmentations": ["z"]}]}
    t = R.read_track_annotations(spark, put(f"{tmp_path}/t.json", json.dumps(doc)))
    assert rows(t, "name", "frame", "is_hand", "clip_id") == [("cup", 0, False, "v"), ("left hand", 0, True, "v"), ("left hand", 1, True, "v")]


def test_snapshots_and_stream_append(spark, tmp_path):
    from clipweave.streaming.streams import append_stream

    df = spark.createDataFrame([("c", 0, 1)], "clip_id string, seg long, n int")
    for stage in ("label", "merge"):
        K.snapshot(df, stage, f"{tmp_path}/snap")
    assert {r["stage"] for r in spark.read.parquet(f"{tmp_path}/snap").collect()} == {"label", "merge"}
    df.write.parquet(f"{tmp_path}/in")
    append_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_documents_that_share_a_file(spark, rows, tmp_path):
    """Many documents in one file give what a file each gives."""
    prompts = [{"video": f"v{i}\n", "W": i, "prompts": [{"t": i / 4, "hand": "L"}] * (i % 3)} for i in range(50)]
    ones = [put(f"{tmp_path}/p/{i}.json", json.dumps(d)) for i, d in enumerate(prompts)]
    many = put(f"{tmp_path}/p.jsonl", "\n".join(map(json.dumps, prompts)))
    cols = ["video", "t_ms", "hand", "W"]
    want = rows(R.read_prompts(spark, ones), *cols)
    assert len(want) == 49 and rows(R.read_prompts(spark, many, lines=True), *cols) == want
    shards = {f"run{i}": [{"tag": "a\tb", "hand": "L", "t": float(j), "obj": j % 2 == 0} for j in range(i % 4)] for i in range(20)}
    ones = [put(f"{tmp_path}/i/{k}/x.json", json.dumps(d)) for k, d in shards.items()]
    many = put(f"{tmp_path}/i.txt", "".join(f"{k}\t{json.dumps(d)}\n" for k, d in shards.items()))
    cols = ["folder", "tag", "t_us", "obj"]
    want = rows(R.read_index(spark, ones), *cols)
    assert len(want) == 30 and rows(R.read_index(spark, [many], packed=True), *cols) == want


def test_logs_that_share_a_file(spark, tmp_path):
    logs = {f"log {i}": [f"{j}\t[{i}] " + "x" * (j % 40) + "\r" * (j % 2) for j in range(30 * i)] + ["", "end"] for i in range(8)}
    put(f"{tmp_path}/a.txt", "".join(f"{k}\t{x}\n" for k, ls in list(logs.items())[:5] for x in ls) + "x_batch\tout\n")
    put(f"{tmp_path}/b.txt", "".join(f"{k}\t{x}\n" for k, ls in list(logs.items())[5:] for x in ls))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = R.read_logs(spark, f"{tmp_path}/*.txt", packed=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.file, r.pos, r.line) for r in got) == sorted((k, i, x.rstrip("\r")) for k, ls in logs.items() for i, x in enumerate(ls))


def test_reader_queries_write_few_files(spark, monkeypatch):
    """The number of written files follows the size, not the number of clips."""
    import os

    import __spark_entry__ as entry
    from clipweave.streaming import streams

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    monkeypatch.setattr(streams, "shared_folder", lambda spark: folder)
    for name in ("read_index", "read_prompts", "read_logs", "read_episodes"):
        entry.queries()[name](spark, "/root/testdata/sf0.01").count()
    files = [f for _, _, fs in os.walk(folder) for f in fs if f.endswith(".txt")]
    assert 4 <= len(files) <= 40  # 150 clips
