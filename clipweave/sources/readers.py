"""Readers for the document formats around a clip; every one is lazy and takes globs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..plans.ordered import Blocks, Ordered, by_size


def _us(sec: Column) -> Column:
    return F.round(sec * 1_000_000).cast("long")


def read_documents(spark: SparkSession, path: str | list[str], schema: str, lines: bool = False) -> DataFrame:
    """JSON documents, one a file, or with ``lines`` one a line: then many share a file, which is read in byte ranges."""
    reader = spark.read.schema(schema)
    return (reader.option("lineSep", "\n") if lines else reader.option("multiLine", True)).json(path)


def read_episodes(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Episode documents; missing keys read as NULL."""
    return read_documents(spark, path, S.EPISODE, lines)


def episode_segments(episodes: DataFrame) -> DataFrame:
    """Segments of the documents as rows in microseconds."""
    e = episodes.select(F.col("clip").alias("clip_id"), F.posexplode("segments").alias("seg", "s"))
    return e.select(
        "clip_id", F.col("seg").cast("long").alias("seg"), _us(F.col("s.start_sec")).alias("start_us"), _us(F.col("s.end_sec")).alias("end_us"),
        F.coalesce("s.left", F.lit("N/A")).alias("left_label"), F.coalesce("s.right", F.lit("N/A")).alias("right_label"),
    )


def read_index(spark: SparkSession, paths: list[str], packed: bool = False) -> DataFrame:
    """Grounding index shards (JSON arrays), tagged with their folder.  File sources skip names that start
    with ``_`` or ``.``, so shards must be published under other names. ``packed``: the shards of many folders in one
    text file, a shard being one line of its folder's name, a tab and the array."""
    schema = "file string, tag string, hand string, t double, seg_id string, `primary` boolean, obj boolean, name string, conf double, low_conf boolean, src string"
    if packed:
        folder, array = _unpacked("value")
        rows = F.from_json(array, f"array<struct<{schema}>>")
        bad = F.array(F.lit(None).cast(f"struct<{schema}>"))  # as in a file: a row of NULLs
        df = spark.read.option("lineSep", "\n").text(paths).select(F.nullif(folder, F.lit("")).alias("folder"), F.inline(F.coalesce(rows, bad)))
    else:
        df = read_documents(spark, paths, schema)
        df = df.withColumn("folder", F.try_element_at(F.split(F.col("_metadata.file_path"), "/"), F.lit(-2)))
    return df.withColumn("t_us", _us(F.col("t")))


def _unpacked(line: str) -> tuple[Column, Column]:
    """Name and rest of a line of a packed file."""
    name = F.substring_index(line, "\t", 1)
    return name, F.substring(line, F.length(name) + 2, F.length(line))


def read_prompts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Prompt documents as rows, keyed by time in milliseconds."""
    p = (
        "struct<t: double, hand: string, seg_id: string, `primary`: boolean, x_px: int, y_px: int, box_px: array<int>, hull_px: array<array<int>>, "
        "thumb_px: array<int>, index_px: array<int>, grip: double, seg: array<double>>"
    )
    df = read_documents(spark, path, f"video string, W int, H int, fps double, prompts array<{p}>", lines)
    df = df.select("video", "W", "H", F.explode("prompts").alias("p")).select("video", "W", "H", "p.*")
    return df.withColumn("t_ms", F.round(F.col("t") * 1000).cast("long"))


def read_inventory(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Inventories whose elements are a plain name or an object with name and role."""
    df = read_documents(spark, path, "tag string, objects array<string>", lines)
    df = df.select("tag", F.posexplode("objects").alias("ord", "o"))
    o = F.from_json("o", "name string, role string")
    is_obj = F.startswith(F.ltrim("o"), F.lit("{"))
    return df.select(
        "tag", "ord", F.when(is_obj, o["name"]).otherwise(F.col("o")).alias("name"), F.coalesce(F.when(is_obj, o["role"]), F.lit("manipulable")).alias("role")
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated pairs, blank lines skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, F.lit(0)).alias("dataset"), F.get(parts, F.lit(1)).alias("clip"))


def read_manifest_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return read_documents(spark, path, "dataset string, name string, ann string, split string, frames string", lines)


def read_logs(spark: SparkSession, glob: str, packed: bool = False) -> DataFrame:
    """Console log lines with their file; batch logs are left out. ``pos`` is the line's number in the file.

    Files are read in byte ranges, so a long log is read by many tasks: lines are numbered inside their range, and
    a table with one row a range says how many lines come before it. ``packed``: many logs in one file, every line led by
    its log's name and a tab, a log's lines in order and in one such file; ranges are then counted log by log."""
    name, rest = _unpacked("value") if packed else (F.col("_metadata.file_name"), F.col("value"))
    df = spark.read.option("lineSep", "\n").text(glob).select(
        F.col("_metadata.file_path").alias("_path"),
        name.alias("file"),
        F.col("_metadata.file_block_start").alias("_from"),
        F.monotonically_increasing_id().alias("_at"),  # in the order of the range
        F.regexp_replace(rest, "\r$", "").alias("line"),
    )
    df = df.where(~F.contains("file", F.lit("_batch")))
    log = ["file", "_path"] if packed else ["_path"]
    ranges = df.groupBy(*log, "_from").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*log).orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*log, "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy(*log, "_from").orderBy("_at")) - 1
    numbered = df.withColumn("_in", inside).join(ranges, [*log, "_from"])
    return numbered.select("file", (F.col("_off") + F.col("_in")).alias("pos"), "line")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.LEDGER).option("sep", "\t").csv(path)


def scan_frames(spark: SparkSession, glob: str, min_bytes: int = 128) -> DataFrame:
    """Frame files that are large enough and start like a JPEG."""
    df = spark.read.format("binaryFile").load(glob).where(F.col("length") >= min_bytes)
    return df.where(F.substring("content", 1, 2) == F.lit(b"\xff\xd8")).select("path", "length", X.frame_number("path").alias("frame"))


def explode_signals(df: DataFrame, key: list[str], arrays: list[str], pos: str = "frame") -> DataFrame:
    """Struct-of-arrays rows to one row per sample; NaN becomes NULL."""
    z = df.select(*key, F.posexplode(F.arrays_zip(*arrays)).alias(pos, "_z"))
    clean = lambda c: F.when(~F.isnan(F.col(f"_z.{c}")), F.col(f"_z.{c}")).alias(c)
    return z.select(*key, F.col(pos).cast("long").alias(pos), *[clean(c) for c in arrays])


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """Hand-signal Parquet (one row per clip and hand) as samples."""
    return explode_signals(spark.read.parquet(path), ["clip_id", "hand"], ["t", "cx", "cy", "grip", "pres"])


def read_keypoints(spark: SparkSession, path: str) -> DataFrame:
    """Keypoint JSON: file name -> hands."""
    hand = "struct<cls: int, conf: double, box: array<double>, kpts: array<array<double>>>"
    df = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, array<{hand}>>").alias("m"))
    df = df.select(F.explode("m").alias("file", "hands")).select("file", F.posexplode("hands").alias("hand_id", "h"))
    return df.select("file", "hand_id", "h.*")


def read_contact_annotations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Per-frame entities with the entity each one touches."""
    ent = "struct<id: string, name: string, in_contact_object: string>"
    df = read_documents(spark, path, f"video_annotations array<struct<image: struct<name: string>, annotations: array<{ent}>>>", lines)
    f = df.select(F.explode("video_annotations").alias("f")).select(F.col("f.image.name").alias("frame"), F.explode("f.annotations").alias("e"))
    return f.select("frame", F.col("e.id").alias("entity"), F.col("e.name").alias("name"), F.col("e.in_contact_object").alias("in_contact"))


def read_track_annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row per object and frame; short arrays simply end early."""
    schema = "videos array<struct<id: bigint, video_name: string, file_names: array<string>>>, annotations array<struct<video_id: bigint, noun_phrase: string, segmentations: array<string>>>"
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    v = df.select(F.explode("videos").alias("v")).select(F.col("v.id").alias("video_id"), F.col("v.video_name").alias("clip_id"))
    a = df.select(F.posexplode("annotations").alias("ord", "a")).select(
        F.col("a.video_id").alias("video_id"), "ord", F.col("a.noun_phrase").alias("name"), F.posexplode_outer("a.segmentations").alias("frame", "segmentation")
    )
    a = a.withColumn("is_hand", F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit("hand")))
    return a.join(v, "video_id")


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Human segments by clip; clips without a file have no rows."""
    return episode_segments(read_episodes(spark, path))


@by_size
def extract_blocks(lines: DataFrame, marker: str = "TRACE [1A seed", blocks: Blocks | None = None) -> DataFrame:
    """Lines of the last marked block of each log: from the marker up to the next timestamp line. ``blocks``
    (measured on ``file`` and ``pos``) cuts long logs into stretches of lines."""
    o = Ordered(["file"], ["pos"], blocks)
    mark = F.contains("line", F.lit(marker))
    d = o.running(lines, {"_block": ("sum", mark.cast("long"))})
    d = o.totals(d, {"_last": ("max", "_block")}).where((F.col("_block") == F.col("_last")) & (F.col("_block") > 0))
    stop = X.is_log_start("line") & ~F.contains("line", F.lit(marker))
    d = o.running(d, {"_stop": ("sum", stop.cast("long"))})
    return d.where(F.col("_stop") == 0).select("file", "pos", "line")


def log_tally(lines: DataFrame, pattern: str) -> DataFrame:
    """Matching lines per log and the last of them."""
    m = lines.where(F.col("line").rlike(pattern))
    return m.groupBy("file").agg(F.count("*").alias("n"), F.max_by("line", "pos").alias("last"))
