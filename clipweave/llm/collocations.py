"""Phrase collocations from a weighted de Bruijn graph (operator 11).

Nodes are word pairs, edges are word triples between overlapping pairs. Only triples are counted: numpy counts
them per slice of texts, and one shuffle by (lang, node) adds them up where all edges of a node meet. A piece also
leaves its last pair and its last word (an edge without a next word, a node without a second word), so that shorter
counts are flows: a pair occurs as often as its node's edges sum to, a word as often as the nodes that begin with it.

Edges of at least ``least`` occurrences are joined to the node they lead to. A node whose whole flow comes in
through one edge and leaves through one is unary; chains of such nodes are compacted into paths by pointer
doubling (as many rounds as the logarithm of the longest chain; a chain lies inside one piece of a text). All triples of a path
have its weight, and all pairs inside it do, so that only a path's ends carry flows of their own. Paths give the
candidates, which then look up their first and last word. Counts multiply as decimals of 38 digits.

Defined cases: a null text is empty; a null lang is ``und`` and joins texts whose lang is ``und``; pieces and words are
cut at single bytes, so text that is not valid UTF-8 is counted byte by byte; rows that repeat count each time; ties
go to the smaller cut, then by occurrences and by the bytes of the phrase; an empty table gives no rows; other
columns are ignored. A group of one lang is ranked in its partitions first, so no task sorts more than the ``top``
rows of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, modest_batches, query, table

LEAST = 10  # occurrences of a candidate
TOP = 2000  # rows of each lang
INSIDE = 50  # percent of a phrase's occurrences that make a longer phrase its owner
SLICE = 16_000_000  # bytes of text counted at once
COUNT = "decimal(14,0)"  # so that 1000000 * a * a stays within 38 digits
BLANK, STOP = b" \t", b".,;:!?\n\x0b\x0c\r"


def byte_kinds() -> tuple[np.ndarray, np.ndarray]:
    """What each byte is (0 in a word, 1 between words, 2 between pieces), and its lower case."""
    kind, lower = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
    kind[list(BLANK)], kind[list(STOP)] = 1, 2
    lower[65:91] += 32
    return kind, lower


def words_of(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all words in order, the words by code, and the number of each word's piece."""
    kind, lower = byte_kinds()
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    kinds = kind[data]
    inside = kinds == 0
    edge = np.diff(inside.view(np.int8), prepend=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(kinds == 2)[start]
    offset = np.append(0, np.cumsum(stop - start))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offset), pa.py_buffer(lower[data[inside]])]).dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary, piece


def triples(texts: list[bytes]) -> pa.RecordBatch | None:
    """(node, next, n) of the distinct triples that begin at each word of ``texts``, cut short where pieces end."""
    code, names, piece = words_of(texts)
    if not len(code):
        return None
    base = len(names) + 1
    second, third = np.zeros_like(code), np.zeros_like(code)  # 0: the piece has ended
    second[:-1] = np.where(piece[1:] == piece[:-1], code[1:] + 1, 0)
    third[:-2] = np.where(piece[2:] == piece[:-2], code[2:] + 1, 0)
    pair = code * base + second
    if base < 1 << 21:
        key, n = np.unique(pair * base + third, return_counts=True)
        pair, third = np.divmod(key, base)
    else:  # three codes do not fit 63 bits: number the pairs first
        pairs, number = np.unique(pair, return_inverse=True)
        key, n = np.unique(number * base + third, return_counts=True)
        number, third = np.divmod(key, base)
        pair = pairs[number]
    first, second = np.divmod(pair, base)

    def name(codes):
        return names.take(pa.array(np.maximum(codes, 1) - 1, mask=codes == 0))

    one = names.take(pa.array(first))
    node = pc.coalesce(pc.binary_join_element_wise(one, name(second), pa.scalar(b" ", pa.large_binary())), one)
    return pa.RecordBatch.from_arrays([node.cast(pa.binary()), name(third).cast(pa.binary()), pa.array(n, pa.int64())], names=["node", "next", "n"])


def counted(docs: DataFrame) -> DataFrame:
    """(lang, node, next, n) summed per slice of each task's texts."""

    def work(batches):
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size > SLICE:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    def flush(held):
        for lang, texts in held.items():
            rows = triples(texts)
            if rows is not None:
                langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(rows.num_rows, np.int32)), pa.array([lang])).cast(pa.string())
                whole = pa.RecordBatch.from_arrays([langs, *rows.columns], names=["lang", *rows.schema.names])
                for at in range(0, whole.num_rows, 20_000):
                    yield whole.slice(at, 20_000)

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    rows = modest_batches(docs).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text)
    return rows.mapInArrow(work, "lang string, node binary, next binary, n long").select("lang", F.col("node").cast("string").alias("node"), F.col("next").cast("string").alias("next"), "n")


def graph(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, node, next, n, flow, lead): of each node its strongest edge (``lead``) and all edges of at least
    ``least``, with the node's flow. Rarer edges have done their part once their node's flow is known."""
    edges = counted(docs).repartition("lang", "node").groupBy("lang", "node", "next").agg(F.sum("n").alias("n"))
    node = Window.partitionBy("lang", "node")
    order = node.orderBy(F.desc("n"), "next")
    edges = edges.select("*", F.row_number().over(order).alias("place"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("flow"))
    edges = edges.filter((F.col("place") == 1) | (F.col("n") >= least))
    return edges.select("lang", "node", F.when(F.col("n") >= least, F.col("next")).alias("next"), "n", "flow", (F.col("place") == 1).alias("lead"))


def words(full: DataFrame) -> DataFrame:
    """(lang, word, count) from the flow of the nodes that begin with a word."""
    return full.filter("lead").groupBy("lang", F.substring_index("node", " ", 1).alias("word")).agg(F.sum("flow").alias("count"))


def pairs(full: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, node, flow) of the pairs that occur at least ``least`` times."""
    return full.filter(F.col("lead") & (F.col("flow") >= least) & F.contains("node", F.lit(" "))).select("lang", "node", "flow")


def frequent(full: DataFrame, nodes: DataFrame, least: int = LEAST) -> DataFrame:
    """Edges of at least ``least`` with the flow of the node they lead to:
    (lang, gram, node, to, next, n, flow, to_flow)."""
    edges = full.filter((F.col("n") >= least) & F.col("next").isNotNull() & F.contains("node", F.lit(" ")))
    edges = edges.select("lang", F.concat_ws(" ", "node", "next").alias("gram"), "node", F.concat_ws(" ", F.substring_index("node", " ", -1), "next").alias("to"), "next", "n", "flow")
    return edges.join(nodes.select("lang", F.col("node").alias("to"), F.col("flow").alias("to_flow")), ["lang", "to"])


def places(edges: DataFrame) -> DataFrame:
    """(lang, gram, head, place) of the edges that follow another through a unary node: the first edge of their
    path and how many edges lie between. Pointers double their reach until all point to first edges."""
    into = edges.filter("n = to_flow").select("lang", F.col("to").alias("node"), F.col("gram").alias("head"))
    link = edges.filter("n = flow").select("lang", "node", "gram").join(into, ["lang", "node"])
    link = kept(link.select("lang", "gram", "head", F.lit(1).cast("long").alias("place"), F.lit(True).alias("moved")))
    while link.filter("moved").limit(1).count():
        above = link.select("lang", F.col("gram").alias("head"), F.col("head").alias("above"), F.col("place").alias("more"))
        moving = link.filter("moved").join(above, ["lang", "head"], "left")
        moved = moving.select("lang", "gram", F.coalesce("above", "head").alias("head"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.col("above").isNotNull().alias("moved"))
        link = kept(moved.unionByName(link.filter("not moved")))
    return link.drop("moved")


def compact(edges: DataFrame) -> DataFrame:
    """(lang, words, n, flow, to_flow): unary paths of ``edges``, their words in order, the weight that all their
    triples have, and the flow of their first and last node. A path is at most as long as a piece of a text."""
    at = edges.join(places(edges), ["lang", "gram"], "left")
    at = at.select("lang", F.coalesce("head", "gram").alias("head"), F.struct(F.coalesce("place", F.lit(0)).alias("place"), "next", "flow", "to_flow").alias("edge"), "n")
    path = at.groupBy("lang", "head").agg(F.array_sort(F.collect_list("edge")).alias("edges"), F.max("n").alias("n"))
    start = F.slice(F.split("head", " "), 1, 2)
    return path.select("lang", F.concat(start, F.transform("edges", lambda e: e["next"])).alias("words"), "n", F.element_at("edges", 1)["flow"].alias("flow"), F.element_at("edges", -1)["to_flow"].alias("to_flow"))


def candidates(paths: DataFrame, nodes: DataFrame, inside: int = INSIDE) -> DataFrame:
    """(lang, phrase, first, last, a, l2, r1): all triples of the paths, with the counts of their first and last pair, and
    the pairs that no triple owns."""
    spread = paths.select("*", F.posexplode(F.expr("transform(sequence(1, size(words) - 2), i -> slice(words, i, 3))")).alias("i", "w"))
    triple = spread.select(
        "lang",
        F.array_join("w", " ").alias("phrase"),
        F.col("w")[0].alias("first"),
        F.col("w")[2].alias("last"),
        F.col("n").alias("a"),
        F.when(F.col("i") == 0, F.col("flow")).otherwise(F.col("n")).alias("l2"),
        F.when(F.col("i") == F.size("words") - 3, F.col("to_flow")).otherwise(F.col("n")).alias("r1"),
    )
    on = paths.select("lang", "n", F.explode(F.expr("transform(sequence(1, size(words) - 1), i -> concat_ws(' ', slice(words, i, 2)))")).alias("node"))
    most = on.groupBy("lang", "node").agg(F.max("n").alias("most"))
    pair = nodes.join(most, ["lang", "node"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < inside * F.col("flow")))
    none = F.lit(None).cast("long")
    pair = pair.select("lang", F.col("node").alias("phrase"), F.substring_index("node", " ", 1).alias("first"), F.substring_index("node", " ", -1).alias("last"), F.col("flow").alias("a"), none.alias("l2"), none.alias("r1"))
    return triple.unionByName(pair)


def scored(found: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) by each candidate's lowest-scoring cut."""
    for end, count in (("first", "l1"), ("last", "r2")):
        found = found.join(vocabulary.select("lang", F.col("word").alias(end), F.col("count").alias(count)), ["lang", end])
    a = F.col("a").cast(COUNT)

    def score(left, right):
        top = F.lit(1_000_000).cast("decimal(7,0)") * a * a
        return F.call_function("div", top, F.col(left).cast(COUNT) * F.col(right).cast(COUNT)).cast("long")

    cut = found.select("lang", "phrase", "a", "l1", "r1", "l2", "r2", F.when(F.col("r1").isNull(), score("l1", "r2")).otherwise(score("l1", "r1")).alias("s1"), score("l2", "r2").alias("s2"))
    one = F.col("s2").isNull() | (F.col("s1") <= F.col("s2"))
    return cut.select(
        "lang",
        "phrase",
        "a",
        F.when(one, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(one & F.col("r1").isNotNull(), F.col("r1")).otherwise(F.col("r2")).alias("r"),
        F.when(one, F.col("s1")).otherwise(F.col("s2")).alias("score"),
    )


def best(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` rows of each lang with their rank; partitions rank their own rows first."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = rows.withColumn("part", F.spark_partition_id())
    own = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.filter(F.col("rank") <= top).drop("part")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each lang's best ``top`` phrases of two or three words."""
    full = kept(graph(docs, least), "zstd")
    vocabulary = kept(words(full))
    total = vocabulary.groupBy("lang").agg(F.sum("count").alias("n"))
    nodes = kept(pairs(full, least))
    edges = kept(frequent(full, nodes, least))
    paths = kept(compact(edges))
    rows = best(scored(candidates(paths, nodes, inside), vocabulary.filter(F.col("count") >= least)), top)
    return rows.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), (VALUES (1), (2), (3)) AS s(k)
  WHERE i + k - 1 <= len(ws) GROUP BY ALL
), c AS (
  SELECT *, string_split(phrase, ' ') AS v FROM g WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, cut, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(c.v[1:cut], ' ')
  JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(c.v[cut + 1:c.k], ' ')
), low AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), owned AS (
  SELECT DISTINCT c.lang, c.phrase FROM c
  JOIN (SELECT lang, f, unnest([v[1] || ' ' || v[2], v[2] || ' ' || v[3]]) AS part FROM c WHERE k = 3) t
    ON t.lang = c.lang AND t.part = c.phrase AND 100 * t.f >= 50 * c.f
), n AS (
  SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang
), r AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM low ANTI JOIN owned USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op11_collocations", SQL)
def op11(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
