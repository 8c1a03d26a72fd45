"""Episode documents written line by line: one JSON document a clip, however long the clip is.

Every list of a document is a table of records. All records of all lists, and the lines around them, are one tagged
union, brought into order by (clip, key, place) in one exchange and one spilling sort, and written as they come: no
list and no document is ever held. A document is spread over lines, so it is plain JSON.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.readers import read_documents

# fixed values: the keys of an episode document in order, and what stands where a clip has nothing to say
KEYS = [
    "clip", "duration_sec", "goal", "instruction", "direction", "phase_switch_sec", "objects", "environment", "meta",
    "phase_boundaries", "_transitions", "_contact_frames", "segments", "subtasks", "left_timeline", "right_timeline",
    "_track", "_contact_track", "_bursts_reduced", "_direction_burst_summary", "_flags", "_seg_trace", "_trace", "_qa",
    "_gate_findings", "_purpose_verdict", "_analysis_report", "_fresh_eye", "_stages", "_clocked", "override_applied",
]
EMPTY = {
    "goal": '""', "instruction": '""', "direction": '""', "phase_switch_sec": "null", "environment": '{"category":""}', "meta": "{}",
    "_direction_burst_summary": '""', "_trace": "{}", "_purpose_verdict": "{}", "_analysis_report": "{}", "_fresh_eye": '""',
    "_clocked": '""', "override_applied": "false",
}
LISTS = {
    "objects": [""], "phase_boundaries": [""], "_transitions": [""], "_contact_frames": [""], "segments": [""], "subtasks": [""],
    "left_timeline": [""], "right_timeline": [""], "_track": ["left", "right"], "_contact_track": ["left", "right"], "_bursts_reduced": [""],
    "_flags": [""], "_seg_trace": [""], "_qa": ["violations"], "_gate_findings": [""], "_stages": [""],
}
OPEN, RECORD, CLOSE = 0, 1, 2


def seconds(us: str) -> Column:
    """Seconds with two decimals, half up in whole numbers."""
    return F.floor((F.col(us) + 5_000) / 10_000) / 100


def records(df: DataFrame, key: str, order: list[str], record: Column, inner: Column | str = "") -> DataFrame:
    """Records of the list ``key`` (with ``inner``: a list inside it) in the order of the columns ``order``, which are
    whole numbers or text; at most three."""
    name = F.lit(inner) if isinstance(inner, str) else inner
    kinds = dict(df.dtypes)
    at = [F.col(c) for c in order] + [F.lit(None)] * (3 - len(order))
    number = lambda c, n: c.cast("long") if n is None or kinds[n] != "string" else F.lit(None).cast("long")
    text = lambda c, n: c.cast("string") if n is not None and kinds[n] == "string" else F.lit(None).cast("string")
    names = [*order, None, None][:3]
    place = F.struct(*[f for i, (c, n) in enumerate(zip(at, names, strict=True)) for f in (number(c, n).alias(f"n{i}"), text(c, n).alias(f"t{i}"))])
    line = F.to_json(record, {"ignoreNullFields": "false"})
    return df.select("clip_id", F.lit(KEYS.index(key)).alias("key"), name.alias("list"), F.lit(RECORD).alias("step"), place.alias("place"), line.alias("line"))


def timeline_sections(segs: DataFrame, lanes: DataFrame, flags: DataFrame, qa: DataFrame) -> list[DataFrame]:
    """The lists that every clip has: segments, subtasks with review marks, one lane per hand, flags and findings.

    ``segs`` has ``needs_review`` and may have ``boundary_provenance`` and ``confidence``. Numbers of segments count from 1
    in the document; a finding on the whole clip (seg -1) has number 0. Flags on segments that are gone are left out."""
    has = set(segs.columns)
    extra = [F.col("boundary_provenance")] if "boundary_provenance" in has else []
    extra += [F.round("confidence", 2).alias("confidence")] if "confidence" in has else []
    base = [seconds("start_us").alias("start_sec"), seconds("end_us").alias("end_sec"), F.col("left_label").alias("left"), F.col("right_label").alias("right"), *extra]
    span = F.struct(seconds("start_us").alias("start_sec"), seconds("end_us").alias("end_sec"), F.col("label").alias("action"), F.lit(False).alias("needs_review"))
    optional = lambda df, *names: [F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names]
    live = flags.join(segs.select("clip_id", "seg"), ["clip_id", "seg"], "left_semi")
    flag = F.struct((F.col("seg") + 1).alias("seg"), *optional(flags, "type", "raised_by", "detail"))
    finding = F.struct((F.col("seg") + 1).alias("seg"), *optional(qa, "hand", "code", "detail"))
    return [
        records(segs, "segments", ["seg"], F.struct(*base)),
        records(segs, "subtasks", ["seg"], F.struct(*base, (F.col("needs_review") == 1).alias("needs_review"))),
        *[records(lanes.where(F.col("hand") == h), f"{h}_timeline", ["start_us", "end_us", "label"], span) for h in ("left", "right")],
        records(live, "_flags", ["seg", "type"], flag),
        records(qa, "_qa", ["seg", "code", "hand"], finding, "violations"),
    ]


def hand_lists(intervals: DataFrame, key: str) -> DataFrame:
    """Intervals of both hands (``clip_id, hand, start_us, end_us, object``) as ``_track`` or ``_contact_track``."""
    span = F.struct(seconds("start_us").alias("start_sec"), seconds("end_us").alias("end_sec"), F.col("object").alias("interacting_with"))
    return records(intervals, key, ["start_us", "end_us", "object"], span, F.col("hand"))


def episode_lines(heads: DataFrame, sections: list[DataFrame]) -> DataFrame:
    """(clip_id, line) of all documents, in order inside each partition.

    ``heads`` has one row a clip: ``clip_id``, ``dur_us`` and, for any other key that is not a list, a column of that name
    (text is quoted, structs become objects; NULL or absent: the empty value). ``sections`` come from `records`."""
    blank = sections[0].schema["place"].dataType
    none = F.lit(None).cast(blank)

    def value(key: str) -> Column:
        if key == "clip":
            return _json(F.col("clip_id").cast("string"))
        if key == "duration_sec":
            return _json(seconds("dur_us"))
        if key == "instruction" and key not in heads.columns:
            return value("goal")
        return F.coalesce(_json(F.col(key)), F.lit(EMPTY[key])) if key in heads.columns else F.lit(EMPTY[key])

    frame = []  # (key, list, step, line) of the lines around records

    def add(key, inner, step, line):
        frame.append(F.struct(F.lit(key).alias("key"), F.lit(inner).alias("list"), F.lit(step).alias("step"), (F.lit(line) if isinstance(line, str) else line).alias("line")))

    for i, key in enumerate(KEYS):
        lead, end = "{" if i == 0 else "", "}" if i == len(KEYS) - 1 else ","
        if key not in LISTS:
            add(i, "", OPEN, F.concat(F.lit(f'{lead}"{key}": '), value(key), F.lit(end)))
            continue
        inner = sorted(LISTS[key])
        for j, name in enumerate(inner):
            first, last = j == 0, j == len(inner) - 1
            begin = (f'"{key}": ' + ("{" if name else "") if first else "") + (f'"{name}": [' if name else "[")
            add(i, name, OPEN, begin)
            add(i, name, CLOSE, "]" + (("}" if name else "") + end if last else ","))
    around = heads.select("*", F.explode(F.array(*frame)).alias("_f")).select("clip_id", "_f.key", "_f.list", "_f.step", none.alias("place"), "_f.line")
    every = reduce(DataFrame.unionByName, sections, around)
    every = every.where(F.col("clip_id").isNotNull())
    w = Window.partitionBy("clip_id").orderBy("key", "list", "step", "place", "line")
    follows = (F.col("step") == RECORD) & (F.lag("step").over(w) == RECORD)
    return every.select("clip_id", F.concat(F.when(follows, ",").otherwise(""), "line").alias("line"))


def _json(c: Column) -> Column:
    """JSON of any value: a list of one, without its brackets."""
    text = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.when(c.isNotNull(), F.substring(text, F.lit(2), F.length(text) - 2))


def write_episode_files(lines: DataFrame, path: str) -> None:
    """One folder a clip (``clip_id=…``) with its document; lines keep the order they come in."""
    lines.write.mode("overwrite").partitionBy("clip_id").text(path)


def write_episode_lines(lines: DataFrame, path: str) -> None:
    """Documents one a line, many to a file: a folder of many clips costs files by its size, not by its clips. A document's
    pieces come one after the other with blanks between, so none is held here either."""
    ends = F.startswith("line", F.lit(f'"{KEYS[-1]}": '))  # records start with a bracket or a comma
    lines.select(F.concat("line", F.when(ends, "\n").otherwise("")).alias("line")).write.mode("overwrite").option("lineSep", " ").text(path)


def read_episode_files(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Documents back as rows (``schema``: DDL of the keys to read); ``lines``: written by `write_episode_lines`."""
    return read_documents(spark, path, schema, lines)
