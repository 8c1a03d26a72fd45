"""Streams against their batch forms, micro-batch by micro-batch."""

import datetime as dt
import random
import tempfile
from types import SimpleNamespace

import pytest

from clipweave.operators import tracks
from clipweave.sinks import writers
from clipweave.sources import readers
from clipweave.streaming import streams

BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "clip_id long, hand string, ts timestamp, t_us long, object string"
NAMES = ["silver bolt", "bolt", "plate", "empty", "none", None, " Plate ", "nut"]


def contact(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for clip in (1, 2):
        for hand in ("left", "right"):
            t = 0
            for _ in range(n // 4):
                t += rng.randint(1, 20)
                rows.append((clip, hand, t, rng.choice(NAMES)))
    rows.sort(key=lambda r: r[2] + rng.randint(0, 25))  # late by up to 25 s
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(c, h, BASE + dt.timedelta(seconds=t), t * 1_000_000, o) for c, h, t, o in rows], SCHEMA)


def source(spark, rows, cuts):
    """Files read one to a micro-batch, in order."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        frame(spark, rows[a:b]).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    paths = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false")
    return paths.parquet(f"{folder}/*")


@pytest.mark.parametrize("cuts", [[], [40, 80, 120], [10, 11, 90]])
def test_late_rows_give_what_the_batch_gives(spark, cuts):
    rows = contact(3)
    end = max(r[2] for r in rows)
    # the last rows move the watermark past all that matters and end what is open
    flush = [(c, h, end + 100 + i, "empty") for c in (1, 2) for h in ("left", "right") for i in range(3)] + [(9, "left", end + 1000, "empty")]
    stream = source(spark, rows + flush, cuts + [len(rows)])
    got = streams.run_available(streams.track_stream(stream, 2_000_000, 2, "60 seconds"))
    want = tracks.build_track(frame(spark, rows + flush), 2_000_000, 2, 0)
    cols = ["clip_id", "hand", "start_us", "end_us", "object"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert got.count() > 10


def test_a_silent_hand_is_closed_by_the_clock(spark):
    rows = [(1, "left", 0, "bolt"), (1, "left", 5, "bolt"), (1, "left", 500, "bolt"), (1, "left", 505, "bolt"), (2, "left", 2000, "bolt")]
    stream = source(spark, rows, [2, 4])
    got = streams.run_available(streams.track_stream(stream, 1, 3, "10 seconds", 100_000_000))
    assert sorted((r.clip_id, r.start_us, r.end_us) for r in got.collect()) == [(1, 0, 5_000_000), (1, 500_000_000, 505_000_000)]


def test_a_batch_that_comes_again_is_there_once(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t"
    first, second = spark.range(5).toDF("x"), spark.range(5, 8).toDF("x")
    for batch, epoch, run in ((first, 0, "a"), (second, 1, "a"), (second, 1, "a"), (first, 0, "b"), (first.limit(2), 0, "a"), (first, 0, "a")):
        streams.replace_epoch(batch, epoch, path, run)
    got = spark.read.parquet(path)
    assert sorted(r.x for r in got.where("run = 'a'").collect()) == list(range(8)) and got.where("run = 'b'").count() == 5


def test_append_stream_can_be_restarted(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = contact(5)
    stream = source(spark, rows, [50]).select("clip_id", "t_us")
    for _ in range(2):  # the second run finds nothing new
        streams.append_stream(stream, f"{folder}/out", f"{folder}/check").awaitTermination()
        assert spark.read.parquet(f"{folder}/out").count() == len(rows)


def test_a_repeated_run_replaces_its_ledger_and_snapshot(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    row = spark.createDataFrame([("f", 1, 10, 2)], "family string, calls long, prompt_tokens long, completion_tokens long")
    for run in ("a", "b", "a"):
        writers.append_ledger(row, f"{base}/ledger", run)
        writers.snapshot(spark.range(3), "first", f"{base}/stages", run)
    writers.snapshot(spark.range(2), "second", f"{base}/stages", "a")
    assert writers.usage_summary(readers.read_ledger(spark, f"{base}/ledger")).first().calls == 2
    got = spark.read.parquet(f"{base}/stages").groupBy("stage").count().collect()
    assert {r.stage: r["count"] for r in got} == {"first": 6, "second": 2}


@pytest.mark.parametrize("master, local", [("local", True), ("local[4]", True), ("local-cluster[2,1,512]", False), ("yarn", False)])
def test_scratch_needs_a_shared_folder_on_a_cluster(master, local):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    if local:
        assert streams.shared_folder(session).startswith("/tmp/spark-")
    else:
        with pytest.raises(ValueError):
            streams.shared_folder(session)
