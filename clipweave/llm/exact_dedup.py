"""Exact deduplication by content sort (operator 1), in DataFrame functions only.

Texts are normalised by deleting white space. Sampled splitters range-partition the leading bytes and a
hash of the normalised text, so equal texts become neighbours in an external sort, and the ordered window
starts a new group wherever the whole normalised text differs from its neighbour's. The sort key also
holds a salt drawn from the id, so a group of any size spreads over tasks: every (text, salt) run
first finds its own best row, then the runs of a text - at most ``SALTS`` small rows without text - agree on
the row that stays, and each run's rows learn it.

The key that splitters are drawn from is short (``LEAD`` code points and two numbers), so the sample at
the driver does not grow with the length of texts.

Defined cases: a null text counts as empty; texts that are empty once normalised form one group; rows
that repeat an id with equal text are one group of which one row is ``kept``; a null id sorts last; an
empty table gives an empty result; other columns are ignored here and pass through ``deduplicate``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, kept, named, query, table

LEAD = 24
SALTS = 64
WHITE = "\t\n\x0b\x0c\r"


def normal_form(text):
    """The text without [\\x20\\x09-\\x0D]."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in " " + WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs`` (doc_id, text)."""
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("size"),
        normal_form(F.col("text")).alias("norm"),
    )
    rows = rows.select(
        "doc_id",
        "size",
        "norm",
        F.substring("norm", 1, LEAD).alias("lead"),
        F.xxhash64("norm").alias("hash"),
        F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    ordered = rows.repartitionByRange("lead", "hash", "salt")
    run = Window.partitionBy("lead", "hash", "salt", "norm")
    best = [F.desc("size"), F.col("doc_id").asc_nulls_last()]
    whole = run.orderBy(*best).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sorted_rows = ordered.select(
        "doc_id",
        "salt",
        F.row_number().over(run.orderBy(*best)).alias("place"),
        F.first(F.struct("size", "doc_id")).over(whole).alias("first"),
        F.sha2("norm", 256).alias("text_sha256"),
    )
    sorted_rows = kept(sorted_rows)  # without texts
    runs = sorted_rows.groupBy("text_sha256", "salt").agg(F.count("*").alias("n"), F.first("first").alias("first"))
    # at most SALTS runs a text
    text = Window.partitionBy("text_sha256")
    pick = text.orderBy(F.desc("first.size"), F.col("first.doc_id").asc_nulls_last(), "salt").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    agreed = runs.select(
        "text_sha256",
        "salt",
        F.first("first.doc_id").over(pick).alias("keep_id"),
        F.first("salt").over(pick).alias("keep_salt"),
        F.sum("n").over(text).alias("group_size"),
    )
    joined = sorted_rows.join(agreed, ["text_sha256", "salt"])
    return joined.select("doc_id", "keep_id", F.col("group_size").cast("long"), ((F.col("place") == 1) & (F.col("salt") == F.col("keep_salt"))).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat id and text, one."""
    key, sha, size, place, hit, own = fresh(docs, "_id", "_sha", "_size", "_place", "_hit", "_own")
    stay = groups(docs).filter("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(hit))
    keyed = docs.select(*named(docs), F.col("doc_id").cast("long").alias(own), F.sha2(normal_form(F.col("text")), 256).alias(sha), F.length("text").alias(size))
    one = keyed.join(stay, F.col(own).eqNullSafe(F.col(key)) & (F.col(sha) == F.col(hit)))
    turn = F.row_number().over(Window.partitionBy(key, hit).orderBy(F.desc(size)))
    return one.withColumn(place, turn).filter(F.col(place) == 1).select(*named(docs))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, norm,
    first_value(doc_id) OVER w AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size,
    row_number() OVER w = 1 AS kept
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM r
"""


@query("op1_exact_dedup", SQL)
def op1(spark, sf_dir):
    return groups(table(spark, sf_dir, "documents"))
