"""Writers and the shapes they write."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def _sec(us: Column) -> Column:
    return F.round(us / 1_000_000, 2)


def assemble_episodes(
    segs: DataFrame, lanes: DataFrame, flags: DataFrame, qa: DataFrame, clips: DataFrame, page: int = 10_000, page_us: int = 36_000_000_000
) -> DataFrame:
    """Episode documents: segments, lanes, flags and QA of a clip nested in one row.  A clip longer than
    ``page_us`` is written as several documents (``part``), so a row stays bounded."""
    part = lambda c: F.floor(F.col(c) / page_us).cast("long").alias("part")
    s = segs.select(
        "clip_id", part("start_us"), F.struct("seg", _sec(F.col("start_us")).alias("start_sec"), _sec(F.col("end_us")).alias("end_sec"), F.col("left_label").alias("left"), F.col("right_label").alias("right"), (F.col("needs_review") == 1).alias("needs_review")).alias("s")
    )
    doc = s.groupBy("clip_id", "part").agg(F.sort_array(F.collect_list("s")).alias("subtasks"))
    l = lanes.select("clip_id", part("start_us"), "hand", F.struct(_sec(F.col("start_us")).alias("start_sec"), _sec(F.col("end_us")).alias("end_sec"), F.col("label").alias("action")).alias("l"))
    pick = lambda h: F.sort_array(F.collect_list(F.when(F.col("hand") == h, F.col("l")))).alias(f"{h}_timeline")
    l = l.groupBy("clip_id", "part").agg(pick("left"), pick("right"))
    where = segs.select("clip_id", "seg", part("start_us"))
    fl = flags.join(where, ["clip_id", "seg"]).groupBy("clip_id", "part").agg(F.sort_array(F.collect_list(F.struct((F.col("seg") + 1).alias("seg"), "type"))).alias("_flags"))
    # a finding on the whole clip (seg -1) goes with its first part
    q = qa.join(where, ["clip_id", "seg"], "left").withColumn("part", F.coalesce("part", F.lit(0).cast("long"))).groupBy("clip_id", "part").agg(F.sort_array(F.collect_list(F.struct((F.col("seg") + 1).alias("seg"), "hand", "code", "detail"))).alias("v"))
    out = doc.join(l, ["clip_id", "part"], "left").join(fl, ["clip_id", "part"], "left").join(q, ["clip_id", "part"], "left").join(clips, "clip_id")
    return out.select(
        F.col("clip_id").cast("string").alias("clip"), "part", _sec(F.col("dur_us")).alias("duration_sec"),
        F.transform("subtasks", lambda x: F.struct(x["start_sec"].alias("start_sec"), x["end_sec"].alias("end_sec"), x["left"].alias("left"), x["right"].alias("right"))).alias("segments"),
        "subtasks", "left_timeline", "right_timeline", "_flags", F.struct(F.col("v").alias("violations")).alias("_qa"), F.lit(False).alias("override_applied"),
    )


def write_episodes(episodes: DataFrame, path: str) -> None:
    episodes.write.mode("overwrite").json(path)


def to_legacy(episodes: DataFrame, model: str = "") -> DataFrame:
    """Older document shape: goal as instruction, default meta and environment, review marks recomputed."""
    bad = F.concat(
        F.coalesce(F.transform("_flags", lambda f: f["seg"] - 1), F.array().cast("array<bigint>")),
        F.coalesce(F.transform(F.filter("_qa.violations", lambda q: q["seg"] > 0), lambda q: q["seg"] - 1), F.array().cast("array<bigint>")),
    )
    sub = F.transform(
        "segments",
        lambda s, i: F.struct(
            s["start_sec"].alias("start_sec"), s["end_sec"].alias("end_sec"), F.coalesce(s["left"], F.lit("")).alias("left"), F.coalesce(s["right"], F.lit("")).alias("right"),
            F.array_contains(F.col("_bad"), i.cast("long")).alias("needs_review"),
        ),
    )
    dur = F.coalesce("duration_sec", "meta.duration_sec")
    return (
        episodes.withColumn("_bad", bad)
        .withColumn("instruction", F.coalesce("goal", F.lit("")))
        .withColumn("environment", F.coalesce("environment", F.struct(F.lit("").alias("category"))))
        .withColumn("meta", F.coalesce("meta", F.struct(dur.alias("duration_sec"), F.lit(model).alias("model"))))
        .withColumn("subtasks", sub)
        .drop("_bad")
    )


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in one global order, as a sink that writes numbered files needs them (a range exchange, no single task)."""
    return df.orderBy(*keys)


def build_manifest(keys: DataFrame) -> DataFrame:
    """Published keys ``<stem>__<version>`` (split at the last ``__``) with the versions of each stem in order."""
    stem, ver = F.regexp_extract("key", "^(.*)__(.*)$", 1), F.regexp_extract("key", "^(.*)__(.*)$", 2)
    has = F.contains("key", F.lit("__"))
    k = keys.select(F.when(has, stem).otherwise(F.col("key")).alias("stem"), F.when(has, ver).otherwise("v?").alias("ver")).distinct()
    return k.groupBy("stem").agg(F.array_join(F.array_sort(F.collect_list("ver")), ",").alias("versions"), F.count("*").alias("n"))


def versions_by_recency(versions: DataFrame) -> DataFrame:
    """Distinct versions, newest first."""
    v = versions.select("ver").distinct().withColumn("rank", X.version_rank("ver"))
    return v.groupBy("rank").agg(F.array_join(F.array_sort(F.collect_list("ver")), ",").alias("vers"))


def eval_report(accuracy: DataFrame) -> DataFrame:
    """Accuracy rows as report rows, four decimals, the overall row named."""
    return accuracy.select(
        F.coalesce(F.col("clip_id").cast("string"), F.lit("OVERALL")).alias("clip"), "slots", "matched", "na_misses", F.round("acc", 4).alias("acc")
    )


def log_report(blocks: DataFrame) -> DataFrame:
    """One Markdown section per log: its index line and the verbatim block."""
    b = blocks.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("b"))
    text = F.array_join(F.transform("b", lambda x: x["line"]), "\n")
    return b.select("file", (F.size("b") - 1).alias("rows"), F.concat(F.lit("## "), "file", F.lit("\n\n```\n"), text, F.lit("\n```")).alias("section"))


def log_index(blocks: DataFrame) -> DataFrame:
    """The report's index as Markdown lines in order (``ord``): a head, then one line per log with its rows."""
    n = blocks.groupBy("file").agg(F.count("*").alias("n"))
    line = F.concat(F.lit("| "), "file", F.lit(" | "), (F.col("n") - 1).cast("string"), F.lit(" |"))
    rows = n.select(F.concat(F.lit("2 "), "file").alias("ord"), line.alias("line"))
    head = n.sparkSession.createDataFrame([("0", "| log | rows |"), ("1", "| --- | --- |")], "ord string, line string")
    return head.unionByName(rows)


def append_ledger(df: DataFrame, path: str, run: str | None = None) -> None:
    """Append rows to the ledger; those of a named ``run`` replace what an earlier try of that run left."""
    if run is None:
        df.write.mode("append").option("sep", "\t").csv(path)
    else:
        _replace(df.withColumn("run", F.lit(run)), "run").option("sep", "\t").csv(path)


def _replace(df: DataFrame, *parts: str):
    """A writer that replaces just the partitions it writes to."""
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts)


def usage_summary(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("family").agg(*[F.sum(c).alias(c) for c in ("calls", "prompt_tokens", "completion_tokens")])


def snapshot(df: DataFrame, stage: str, path: str, run: str | None = None) -> None:
    """Append a stage's timeline, partitioned by stage; of a named ``run``, replacing that run's earlier try."""
    df = df.withColumn("stage", F.lit(stage))
    if run is None:
        df.write.mode("append").partitionBy("stage").parquet(path)
    else:
        _replace(df.withColumn("run", F.lit(run)), "stage", "run").parquet(path)


def upsert_fields(base: DataFrame, new: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Set fields from ``new`` where it has the key; other rows stay."""
    n = new.select(*key, *[F.col(f).alias(f"_{f}") for f in fields])
    keep = [c for c in base.columns if c not in fields]
    return base.join(n, key, "left").select(*keep, *[F.coalesce(f"_{f}", f).alias(f) if f in base.columns else F.col(f"_{f}").alias(f) for f in fields])


def merge_last_wins(df: DataFrame, key: list[str], value: str, run: str) -> DataFrame:
    return df.groupBy(*key).agg(F.max_by(value, run).alias(value))


def merge_shards(shards: list[DataFrame]) -> DataFrame:
    """Union of worker outputs; columns a worker lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)


def failed_workers(workers: DataFrame) -> DataFrame:
    return workers.agg(F.count("*").alias("workers"), F.count_if(F.col("rc") != 0).alias("failed"))
