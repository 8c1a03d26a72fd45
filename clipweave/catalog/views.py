"""Timeline views over the driver tables: the Spark side, and the same views as SQL for the check.

One user's events play the part of one clip.  Event spacing is hours, so one reference second is
one hour here (`U`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ordered import Blocks, Ordered

U = 3_600_000_000  # one hour in microseconds stands for one second of video
DAY = 24 * U
KEY = ["clip_id"]

# fixed values: the label verbs used to dress events as actions
VERBS = [
    "hold the",
    "place the",
    "pick up the",
    "unscrew the",
    "screw on the",
    "insert the",
    "tighten and loosen the",
    "attach the",
    "put down the",
    "take the",
]

_blocks: dict[tuple[str, str], Blocks | None] = {}


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str, blocks="measure"):
        self.spark, self.dir = spark, sf_dir
        self._given = blocks

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def blocks(self) -> Blocks | None:
        """How to split long clips: measured once per session and table, or set by the conf
        ``spark.clipweave.blockWidth`` (tests force the split plan with it, on all clips or on those
        with an id divisible by ``spark.clipweave.hotEvery``)."""
        forced, every = (self.spark.conf.get(f"spark.clipweave.{n}", None) for n in ("blockWidth", "hotEvery"))
        if forced is not None:
            ids = self.table("events").select(F.col("user_id").alias("clip_id")).where(F.col("clip_id") % int(every or 1) == 0)
            return Blocks(int(forced), ids.distinct() if every else None)
        if self._given != "measure":
            return self._given
        k = (self.spark.sparkContext.applicationId, self.dir)
        if k not in _blocks:
            _blocks[k] = Blocks.measure(self.obs().select("clip_id", "t_us"), KEY, "t_us")
        return _blocks[k]

    def ordered(self, key=("clip_id",), order=("t_us",)) -> Ordered:
        return Ordered(list(key), list(order), self.blocks)

    def obs(self) -> DataFrame:
        """Frames without a running number."""
        e = self.table("events")
        t_us = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"), F.col("ts"))
        return e.select(
            F.col("user_id").alias("clip_id"),
            t_us.alias("t_us"),
            "event_id",
            "event_type",
            F.get_json_object("props", "$.k").cast("int").alias("k"),
            F.when(F.col("event_type") == "error", "empty").otherwise(F.col("event_type")).alias("left_touching"),
            F.when(F.col("event_id") % 5 == 0, "out of frame")
            .otherwise(F.concat("event_type", F.lit(" part")))
            .alias("right_touching"),
            F.when(F.col("event_id") % 7 != 0, F.round(F.col("value") * 100).cast("long")).alias("signal"),
        )

    def frames(self) -> DataFrame:
        return self.ordered().number(self.obs(), "frame")

    @staticmethod
    def _label(empty: str, touching: str, k) -> F.Column:
        verb = F.element_at(F.array(*[F.lit(v) for v in VERBS]), (k % len(VERBS)).cast("int") + 1)
        return F.when(F.col(touching) == empty, "N/A").otherwise(F.concat(verb, F.lit(" "), F.col(touching)))

    def segments(self) -> DataFrame:
        f = self.ordered().neighbours(self.obs(), next={"end_us": "t_us"})
        f = f.where(F.col("end_us").isNotNull()).select(
            "clip_id",
            F.col("t_us").alias("start_us"),
            "end_us",
            self._label("empty", "left_touching", F.col("k")).alias("left_label"),
            self._label("out of frame", "right_touching", F.floor(F.col("k") / 10)).alias("right_label"),
            "k",
            "event_type",
        )
        return self.ordered(order=("start_us",)).number(f, "seg")

    def transitions(self) -> DataFrame:
        return (
            self.obs()
            .where(F.col("event_type").isin("purchase", "signup", "click"))
            .select(
                "clip_id",
                "t_us",
                F.when(F.col("k") % 2 == 0, "left").otherwise("right").alias("hand"),
                F.when(F.col("event_type") == "purchase", "place")
                .when(F.col("event_type") == "signup", "pickup")
                .otherwise("handoff")
                .alias("kind"),
                F.concat(F.lit("part "), (F.col("k") % 7).cast("string")).alias("object"),
            )
        )

    def track(self) -> DataFrame:
        left = F.col("k") % 2 == 0
        hours = 1 + F.when(left, F.col("k") % 5).otherwise(F.col("k") % 7)
        return self.obs().select(
            "clip_id",
            F.when(left, "left").otherwise("right").alias("hand"),
            F.col("t_us").alias("start_us"),
            (F.col("t_us") + F.lit(U) * hours).alias("end_us"),
            F.when(left, F.col("left_touching")).otherwise(F.col("right_touching")).alias("object"),
        )

    def raw(self) -> DataFrame:
        held = lambda hand, empty, verb: F.when(
            (F.col("hand") == hand) & (F.col("object") != empty), F.concat(F.lit(verb), F.col("object"))
        ).otherwise("N/A")
        return self.track().select(
            "clip_id",
            "start_us",
            "end_us",
            held("left", "empty", "hold the ").alias("left_label"),
            held("right", "out of frame", "place the ").alias("right_label"),
        )

    def truth(self) -> DataFrame:
        return self.obs().where(F.col("event_type") != "view").select("clip_id", "t_us")

    def pred(self) -> DataFrame:
        return (
            self.obs()
            .where(F.col("event_type") != "error")
            .select("clip_id", (F.col("t_us") + F.lit(60_000_000) * (F.col("k") % 3)).alias("t_us"))
        )

    def turns(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").alias("clip_id"),
            F.col("turn").alias("seg"),
            F.col("turn").alias("start_us"),
            (F.col("turn") + 1).alias("end_us"),
            F.col("role").alias("left_label"),
            F.lower("text").alias("right_label"),
        )

    def clips(self) -> DataFrame:
        """Clip durations: end of the last frame plus one reference second."""
        return self.obs().groupBy("clip_id").agg((F.max("t_us") + F.lit(U)).alias("dur_us"))

    def masks(self) -> DataFrame:
        """One 64-bit mask per vector; twenty candidates to a frame however large the table is."""
        word = F.aggregate(
            F.sequence(F.lit(0), F.lit(63)),
            F.lit(0).cast("long"),
            lambda acc, i: acc.bitwiseOR(
                F.when(F.get("embedding", i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
            ),
        )
        return self.table("embeddings").select(
            F.floor(F.col("vec_id") / 20).alias("frame"),
            F.col("vec_id").alias("cand"),
            F.concat(F.lit("object "), F.col("label").cast("string")).alias("name"),
            word.alias("mask"),
            F.floor(F.abs(F.get("embedding", F.lit(0)).cast("double")) * 1_000_000).cast("long").alias("score"),
        )


_VERB_SQL = "[" + ", ".join(f"'{v}'" for v in VERBS) + "]"

BASE = f"""WITH RECURSIVE v_obs AS (
 SELECT user_id AS clip_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS t_us, event_id, event_type,
  CAST(json_extract_string(props,'$.k') AS INT) AS k,
  CASE WHEN event_type='error' THEN 'empty' ELSE event_type END AS left_touching,
  CASE WHEN event_id % 5 = 0 THEN 'out of frame' ELSE event_type || ' part' END AS right_touching,
  CASE WHEN event_id % 7 <> 0 THEN CAST(round(value*100) AS BIGINT) END AS signal FROM events),
v_frames AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY clip_id ORDER BY t_us) - 1 AS frame FROM v_obs),
v_segments AS (SELECT * FROM (SELECT clip_id, t_us AS start_us,
  LEAD(t_us) OVER (PARTITION BY clip_id ORDER BY t_us) AS end_us,
  CASE WHEN left_touching='empty' THEN 'N/A' ELSE {_VERB_SQL}[k % 10 + 1] || ' ' || left_touching END AS left_label,
  CASE WHEN right_touching='out of frame' THEN 'N/A' ELSE {_VERB_SQL}[(k // 10) % 10 + 1] || ' ' || right_touching END AS right_label,
  k, event_type, frame AS seg FROM v_frames) WHERE end_us IS NOT NULL),
v_transitions AS (SELECT clip_id, t_us, CASE WHEN k % 2 = 0 THEN 'left' ELSE 'right' END AS hand,
  CASE event_type WHEN 'purchase' THEN 'place' WHEN 'signup' THEN 'pickup' ELSE 'handoff' END AS kind,
  'part ' || (k % 7) AS object FROM v_obs WHERE event_type IN ('purchase','signup','click')),
v_track AS (SELECT clip_id, CASE WHEN k % 2 = 0 THEN 'left' ELSE 'right' END AS hand, t_us AS start_us,
  t_us + {U} * (1 + CASE WHEN k % 2 = 0 THEN k % 5 ELSE k % 7 END) AS end_us,
  CASE WHEN k % 2 = 0 THEN left_touching ELSE right_touching END AS object FROM v_obs),
v_raw AS (SELECT clip_id, start_us, end_us,
  CASE WHEN hand='left' AND object<>'empty' THEN 'hold the ' || object ELSE 'N/A' END AS left_label,
  CASE WHEN hand='right' AND object<>'out of frame' THEN 'place the ' || object ELSE 'N/A' END AS right_label FROM v_track),
v_truth AS (SELECT clip_id, t_us FROM v_obs WHERE event_type <> 'view'),
v_pred AS (SELECT clip_id, t_us + 60000000 * (k % 3) AS t_us FROM v_obs WHERE event_type <> 'error'),
v_turns AS (SELECT conv_id AS clip_id, turn AS seg, turn AS start_us, turn + 1 AS end_us, role AS left_label,
  lower(text) AS right_label FROM conversations),
v_clips AS (SELECT clip_id, max(t_us) + {U} AS dur_us FROM v_obs GROUP BY clip_id),
v_masks AS (SELECT vec_id // 20 AS frame, vec_id AS cand, 'object ' || label AS name,
  list_transform(embedding, lambda x: x > 0) AS bits,
  CAST(floor(abs(CAST(embedding[1] AS DOUBLE)) * 1000000) AS BIGINT) AS score FROM embeddings)
"""


def sql(body: str, *ctes: str) -> str:
    """Oracle text: the views, further common table expressions, and the final select."""
    return BASE + "".join(f", {c.strip()}\n" for c in ctes) + body
