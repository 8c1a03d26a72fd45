"""Line deduplication by a segment-partition edit join (operator 7), in DataFrame functions only.

Equal lines fall into one class by an aggregation that combines before its shuffle. A line is cut into
``edits + 1`` segments; if another is within ``edits`` edits, one segment at least occurs in it unchanged. Each
line is indexed under (length, segment number, segment) and probes the indexes of its own and the
``edits`` shorter lengths with those of its substrings that can be such a segment in an alignment with edits left
of and right of it (at most twelve for two edits). Meeting pairs are verified by Spark's edit distance with a threshold, which
fills only the band around the diagonal. It is not bit-parallel: bit-vector arithmetic over a string of
any length has no counterpart among the built-in functions.

No length is left out: lines of at most ``edits`` code points have empty segments, which occur in every line, so they meet
all lines whose length allows a link. With ``min_chars``, lines of fewer code points are compared for equality only.
``deduplicate`` takes ``edits + 1`` for it: below that any two lines link, and an empty line would remove them all.

Defined cases: a null text has no lines; an empty text is one empty line; rows that repeat an id give
further occurrences; a null id sorts last; an empty table gives an empty result; other columns are ignored,
and pass through ``deduplicate``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, kept, named, query, table

EDITS = 2
MIN_CHARS = 0


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of every line; line numbers start at 0."""
    lines = F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("line_no", "line")
    return docs.filter("text is not null").select(F.col("doc_id").cast("long"), lines)


def classes(docs: DataFrame) -> DataFrame:
    """(id, line, chars, first, n) of every distinct line; ``first`` is its smallest (doc_id, line_no)."""
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "line_no")
    each = lines_of(docs).groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    return kept(each.select(F.monotonically_increasing_id().alias("id"), "line", F.length("line").alias("chars"), "first", "n"), "zstd")


def segment(chars, i: int, edits: int):
    """(start, length) of segment ``i`` from 0; the first ones are the shorter ones. Starts count from 1."""
    k = edits + 1
    base = F.floor(chars / k)
    extra = chars - base * k  # so many segments at the end are longer by one
    longer = F.greatest(F.lit(0), F.lit(i - k) + extra)  # of the segments before this one
    return (base * i + longer + 1).cast("int"), (base + F.when(F.lit(i - k) + extra >= 0, 1).otherwise(0)).cast("int")


def keys(lines: DataFrame, edits: int) -> tuple[DataFrame, DataFrame]:
    """(key, id) of the index and of the probes."""
    chars = F.col("chars")
    index, probes = [], []
    for i in range(edits + 1):
        start, size = segment(chars, i, edits)
        index.append(F.xxhash64(chars, F.lit(i), F.substring(F.col("line"), start, size)))
    for shift in range(edits + 1):  # the other line is shorter by so many
        other = chars - shift
        for i in range(edits + 1):
            start, size = segment(other, i, edits)
            for move in range(max(-i, shift - (edits - i)), min(i, shift + (edits - i)) + 1):
                probes.append(F.xxhash64(other, F.lit(i), F.substring(F.col("line"), start + move, size)))
    return lines.select("id", F.explode(F.array(*index)).alias("key")), lines.select("id", F.explode(F.array_distinct(F.array(*probes))).alias("key"))


def near(lines: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(a, b), a < b: the classes of ``lines`` within ``edits`` edits of each other."""
    fit = lines.filter(F.col("chars") >= min_chars)
    index, probes = keys(fit, edits)
    pairs = index.withColumnRenamed("id", "a").join(probes.withColumnRenamed("id", "b"), "key").filter("a <> b")
    pairs = kept(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    text = fit.select("id", "line")
    both = pairs.join(text.select(F.col("id").alias("a"), F.col("line").alias("la")), "a").join(text.select(F.col("id").alias("b"), F.col("line").alias("lb")), "b")
    return both.filter(F.levenshtein("la", "lb", edits) >= 0).select("a", "b")


def marked(lines: DataFrame, links: DataFrame) -> DataFrame:
    """``lines`` with n_links of each class and ``kept``: none of the classes it links with comes first."""
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = lines.select(F.col("id").alias("b"), F.col("first").alias("other"))
    linked = ends.join(first, "b").groupBy("a").agg(F.count("*").alias("n_links"), F.min("other").alias("other"))
    out = lines.join(linked.withColumnRenamed("a", "id"), "id", "left")
    return out.select(
        "id",
        "line",
        "chars",
        "first",
        "n",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("first") <= F.col("other"), F.lit(True)).alias("kept"),
    )


def judged(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per distinct line: its first place (doc_id, line_no), n_rows, n_links to other lines within
    ``edits`` edits, ``kept`` (none of those comes first), chars and line_sha256."""
    lines = classes(docs)
    out = marked(lines, kept(near(lines, edits, min_chars)))
    place = F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no")
    return out.select(*place, F.col("n").alias("n_rows"), "n_links", "kept", "chars", F.sha2("line", 256).alias("line_sha256"))


def members_and_links(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Two kinds of rows. ``line``: every occurrence (doc_id, line_no) with its class_id (the line's SHA-256), the class's
    n_rows, n_links and chars, and ``kept`` (the first place of a class that links with no earlier one; rows that repeat
    an id share its places). ``link``: the pairs class_id < other_id of classes within ``edits`` edits, once each."""
    digest = F.unhex(F.sha2("line", 256)).alias("key")
    lines = classes(docs)
    links = kept(near(lines, edits, min_chars))
    each = kept(marked(lines, links).select("id", digest, "chars", "first", "n", "n_links", "kept"))
    here = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))
    name = lambda c: F.lower(F.hex(c))
    rows = lines_of(docs).select("doc_id", "line_no", digest).join(each.drop("id"), "key")
    rows = rows.select(F.lit("line").alias("kind"), "doc_id", "line_no", name("key").alias("class_id"), F.col("n").alias("n_rows"), "n_links", (F.col("kept") & here).alias("kept"), "chars")
    end = lambda c: each.select(F.col("id").alias(c), F.col("key").alias(f"key_{c}"))
    ends = links.join(end("a"), "a").join(end("b"), "b")
    pairs = ends.select(F.lit("link").alias("kind"), name(F.least("key_a", "key_b")).alias("class_id"), name(F.greatest("key_a", "key_b")).alias("other_id"))
    return rows.unionByName(pairs, allowMissingColumns=True)


def deduplicate(docs: DataFrame, edits: int = EDITS, min_chars: int | None = None) -> DataFrame:
    """The documents without lines that repeat an earlier one, or are within ``edits`` edits of one. Of a
    line's occurrences the first stays; an empty line stays wherever it is, as layout."""
    stay = judged(docs, edits, edits + 1 if min_chars is None else min_chars).filter("kept").select("doc_id", "line_no", "line_sha256")
    row, new = fresh(docs, "_row", "_new")
    whole = kept(docs.select(*named(docs), F.monotonically_increasing_id().alias(row)))
    line = F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("line_no", "line")
    each = whole.filter("text is not null").select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id"), line).withColumn("sha", F.sha2("line", 256))
    hit = stay.select(F.col("doc_id").alias("hit_id"), F.col("line_no").alias("hit_no"), F.col("line_sha256").alias("hit_sha"))
    match = F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("line_no") == F.col("hit_no")) & (F.col("sha") == F.col("hit_sha"))
    once = each.join(hit, match, "left")
    turn = F.row_number().over(Window.partitionBy("id", "line_no", "sha").orderBy("row"))
    left = once.withColumn("turn", turn).filter("(hit_sha is not null and turn = 1) or line = ''")
    rest = F.array_sort(F.collect_list(F.struct("line_no", "line")))  # the lines of one document
    text = left.groupBy("row").agg(rest.alias("rest")).select(F.col("row").alias(row), F.array_join("rest.line", "\n").alias(new))
    full = whole.join(text, row, "left")
    cleaned = F.when(F.col("text").isNotNull(), F.coalesce(F.col(new), F.lit("")))
    return full.select(*(cleaned.alias(c) if c == "text" else col for c, col in zip(docs.columns, named(docs), strict=True)))


@query("op7_line_dedup")
def op7(spark, sf_dir):
    return members_and_links(table(spark, sf_dir, "documents"))
