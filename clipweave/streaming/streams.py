"""Structured Streaming forms of the windowed and stateful operators.

The window and session functions take a batch or a streaming frame; only the caller differs.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.possession import Possession, frame_columns


def sliding_counts(df: DataFrame, ts: str, keys: list[str], width: str, step: str, delay: str | None = None) -> DataFrame:
    """Rows per key in sliding windows."""
    if delay:
        df = df.withWatermark(ts, delay)
    g = df.groupBy(F.window(ts, width, step).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sessions(df: DataFrame, ts: str, keys: list[str], gap: str, delay: str | None = None) -> DataFrame:
    """Bursts of rows less than ``gap`` apart (a session ends ``gap`` after its last row)."""
    if delay:
        df = df.withWatermark(ts, delay)
    g = df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return g.select(*keys, "first", "last", "n")


def deduplicate(df: DataFrame, ts: str, keys: list[str], delay: str) -> DataFrame:
    """First copy of each fact; copies arriving within ``delay`` are dropped."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def track_stream(contact: DataFrame, min_us: int, empty_split: int, delay: str, idle_us: int | None = None) -> DataFrame:
    """Possession intervals from a stream of contact rows (``clip_id, hand, ts, t_us, object``), the same as
    `build_track` gives before it snaps gaps, in whatever micro-batches the rows come.

    Rows wait in the state of their clip and hand until the watermark (``delay`` behind the latest row of all) has
    passed them; an event-time timer releases them in order of time, so rows late by less than the delay take their
    place. The state holds the open interval and the rows of one delay. With ``idle_us`` an interval also ends
    where that long nothing came, which lets a hand that went silent be forgotten."""
    import pickle

    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    out = "clip_id bigint, hand string, start_us bigint, end_us bigint, object string"
    # waiting rows (ts, t, shown, same, ties, empty) are kept as one binary value, which Spark need not take apart
    state = "start_us bigint, end_us bigint, same string, ties array<string>, votes map<string,bigint>, empties bigint, last bigint, rows binary"

    def step(key, batches: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        *interval, last, rows = st.get if st.exists else (None, None, None, [], {}, 0, None, None)
        hand = Possession(min_us, empty_split, tuple(interval))
        rows, done = pickle.loads(bytes(rows)) if rows else [], []
        if not st.hasTimedOut:
            for b in batches:
                rows += zip(b["_ts"].tolist(), b["t_us"].tolist(), b["_shown"].tolist(), b["_same"].tolist(), map(list, b["_ties"]), b["_empty"].tolist(), strict=True)
        passed = st.getCurrentWatermarkMs() * 1000
        for ts, *frame in sorted(r for r in rows if r[0] <= passed):
            if idle_us is not None and last is not None and ts - last >= idle_us:
                done.append(hand.close())
            done.append(hand.feed(*frame))
            last = ts
        rows = [r for r in rows if r[0] > passed]
        if idle_us is not None and last is not None and passed - last >= idle_us:
            done.append(hand.close())
        ring = min(r[0] for r in rows) if rows else last + idle_us if hand.is_open and idle_us is not None else None
        if ring is None and not hand.is_open:
            if st.exists:
                st.remove()
        else:
            st.update((*hand.state(), last, pickle.dumps(rows) if rows else None))
            if ring is not None:
                st.setTimeoutTimestamp(max(st.getCurrentWatermarkMs(), ring // 1000) + 1)
        found = [(key[0], key[1], *d) for d in done if d]
        if found:
            yield pd.DataFrame(found, columns=["clip_id", "hand", "start_us", "end_us", "object"])

    says = frame_columns()
    rows = contact.select(
        "clip_id", "hand", "ts", F.unix_micros("ts").alias("_ts"), "t_us", says["shown"].alias("_shown"), says["same"].alias("_same"), says["ties"].alias("_ties"), says["empty"].alias("_empty")
    )
    g = rows.withWatermark("ts", delay).groupBy("clip_id", "hand")
    return g.applyInPandasWithState(step, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only in local mode where the session names none."""
    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if folder is None and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming frame over what is available now, through a file sink in the shared folder, and
    read the result back."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def replace_epoch(batch: DataFrame, epoch: int, path: str, run: str = "stream") -> None:
    """Write one micro-batch as the partition (``run``, ``epoch``) of a table. A batch that comes again after a
    failure, with the same number, replaces what its first try left, so nothing is there twice."""
    tagged = batch.withColumn("run", F.lit(run)).withColumn("epoch", F.lit(epoch).cast("long"))
    writer = tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run", "epoch").parquet(path)


def append_stream(df: DataFrame, path: str, checkpoint: str, run: str = "stream"):
    """Append each micro-batch to a table (ledger, snapshots), once however often it is tried; streams that write to
    one table have a ``run`` of their own."""
    write = lambda batch, epoch: replace_epoch(batch, epoch, path, run)
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
