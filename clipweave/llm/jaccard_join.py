"""Exact Jaccard join on word shingles in the metric space of shingle sets (operator 8).

Distance is 1 - Jaccard; two documents link when it is at most ``1 - THRESHOLD``. As nearly all documents lie at
distance 1 from one another, pivots drawn blindly would have every document in every window. So pivots
are chosen where distances can be small: a document belongs to the regions of the rarest fifth of its
shingles, of which two linked documents share at least one, and each region elects the member with the
smallest hash as its pivot. Steps:

1. Equal sets fall into one class. A sketch counts shingles over all documents; it only orders them, from
   rare to frequent, so its size bears on the cost and never on the result.
2. Classes meet their regions' pivots - the member that holds the fewest shingles no other has, as the one in the
   middle of a group of near copies does; exact distances to pivots are computed, and links join components.
3. A region whose members are in one component is settled: nothing more can change the components there. In
   the others, shingles that no other open component has bound overlaps and rule documents out.
4. Around a pivot, documents are their differences from it, which are few for near copies. Two documents differ by what
   only one of their differences holds, so two that link, and are not both linked with the pivot already, have common
   differences, and the more the farther they are from the pivot. Pairs meet by the rarest of their differences
   (prefix and positional filters) and are verified on the differences alone, exactly.
5. Documents with less than ``1 - APART`` in common with the pivot, or too large or small to be compared with it, meet
   in their regions: the triangle inequality leaves, for each, the window of members whose distance to
   the pivot differs by at most the threshold. Further pivots (``GROWTH`` times as many in each round, until
   all members are) are compared with what is left, until all regions are settled.

Regions are rows, never collected; a region of any size is spread by joins on pairs. Only the sketch
(2 ** ``BITS`` bytes) and a bit map that thins the scan for texts (2 ** ``BITS`` bits) are broadcast.

Defined cases: a null text counts as empty; a text without words has no set and is linked with nothing;
with fewer than five words the whole sequence is its one shingle; repeated rows are in one component; a null id
takes part and is the smallest only where no other id is there; an empty table gives an empty result;
other columns are ignored by ``join`` and pass through ``representatives``.
"""

from __future__ import annotations

import functools
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_text, fresh, kept, modest_batches, named, plain_names, query, table, texts_of
from .components import components

SIZE = 5
PERCENT = 80
BITS, SLICES = 23, 64
GROWTH = 16
MORE = 16  # the larger, the shorter the prefixes, and the fewer members they must have in common
APART = 0.6  # distance from the pivot up to which differences are fewer than what is common
_C = np.random.default_rng(20).integers(1, 2**63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h


@functools.lru_cache(maxsize=2)
def hashes(seed: int) -> Hashes:
    return Hashes(seed)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sets_of(texts: list[str], seed: int = 0) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = [t.encode().lower().split() for t in texts]
    flat = np.fromiter(map(hashes(seed).__getitem__, chain.from_iterable(words)), np.uint64)
    n = len(flat)
    roll = np.zeros(max(0, n - SIZE + 1), np.uint64)
    for k in range(SIZE):
        roll += flat[k : k + len(roll)] * _C[k]
    roll = mixed(roll)
    out, at = [], 0
    for w in map(len, words):
        if w >= SIZE:
            s = np.sort(roll[at : at + w - SIZE + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif w:
            out.append(mixed(np.array([(flat[at : at + w] * _C[:w]).sum() + np.uint64(w)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        at += w
    return out


def key_of(s: np.ndarray, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed) - 2**63


def prefix(n: int) -> int:
    """How many of a set's rarest members hold, of any set of m that reaches the threshold with it, ``1 + min(n, m) // MORE``
    of that set's own such members. One member less in the prefix is one less in common."""
    return n - -(-PERCENT * n // 100) + 1 + n // MORE


def bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BITS)).astype(np.int64)


def rarest(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The prefix of a set in the order of the sketch. Even hashes come first, and only they are counted:
    half of a set is more than its prefix, and the sketch tells twice as many apart."""
    odd = s % np.uint64(2)
    rank = np.where(odd == 0, level[bucket(s)], 255).astype(np.uint64)
    order = np.argsort((odd << np.uint64(63)) | (rank << np.uint64(55)) | (s >> np.uint64(9)), kind="stable")
    return s[order[: prefix(len(s))]]


def first_pass(docs: DataFrame, seed: int) -> DataFrame:
    """Rows (doc_id, n, x, y) of all documents - set size and two hashes of the set - and, with ``slice`` not null,
    each task's shingle counts in compressed slices."""

    def work(batches):
        counts = np.zeros(1 << BITS, np.uint32)
        none = lambda n, t: pa.nulls(n, t)
        names = ["doc_id", "n", "x", "y", "slice", "counts"]
        for batch in by_text(batches):
            sets = sets_of(texts_of(batch), seed)
            every = np.concatenate(sets)
            np.add.at(counts, bucket(every[every % np.uint64(2) == 0]), np.uint32(1))
            r = len(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([key_of(s, 0) for s in sets], pa.int64()), pa.array([key_of(s, 1) for s in sets], pa.int64()), none(r, pa.int32()), none(r, pa.binary())], names=names
            )
        parts = [(i, zlib.compress(c.tobytes(), 1)) for i, c in enumerate(np.split(counts, SLICES)) if c.any()]
        if parts:
            r = len(parts)
            yield pa.RecordBatch.from_arrays([none(r, pa.int64())] * 4 + [pa.array([i for i, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())], names=names)

    return docs.mapInArrow(work, "doc_id long, n long, x long, y long, slice int, counts binary")


def levels(parts: DataFrame) -> np.ndarray:
    """Log-scaled counts of all buckets: 2 ** BITS bytes, whatever the input."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, c in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                new = np.frombuffer(zlib.decompress(c), np.uint32).astype(np.uint64)
                total[i] = total[i] + new if i in total else new
        for i, c in total.items():
            level = np.minimum(255, np.round(6 * np.log2(1 + c.astype(float)))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["slice", "level"])

    out = np.zeros((SLICES, (1 << BITS) // SLICES), np.uint8)
    for r in parts.repartition(SLICES, "slice").mapInArrow(add, "slice int, level binary").collect():  # SLICES rows of fixed size
        out[r.slice] = np.frombuffer(r.level, np.uint8)
    return out.ravel()


def regions(docs: DataFrame, level: np.ndarray, seed: int) -> DataFrame:
    """(x, n, rare): of every class its rarest shingles; copies in one task are sent once."""
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def work(batches):
        known = shared.value
        sent: set[int] = set()
        for batch in by_text(batches):
            xs, ns, rare = [], [], []
            for s in sets_of(texts_of(batch), seed):
                x = key_of(s, 0)
                if not len(s) or x in sent:
                    continue
                if len(sent) > 1_000_000:
                    sent.clear()
                sent.add(x)
                xs.append(x), ns.append(len(s)), rare.append(rarest(s, known).view(np.int64))
            if xs:
                flat = pa.array(np.concatenate(rare))
                at = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rare])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(at, flat)], names=["x", "n", "rare"])

    return docs.mapInArrow(work, "x long, n long, rare array<long>")


def compatible(a: str, b: str):
    """Sizes that can reach the threshold."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def compared(pairs: DataFrame, text: DataFrame, seed: int) -> DataFrame:
    """(x, p, inter, either): the exact sizes of intersection and union of each pair of classes."""

    def work(batches):
        last, set_p = None, None
        for batch in batches:
            xs, ps = batch.column("x").to_pylist(), batch.column("p").to_pylist()
            tx, tp = batch.column("tx"), batch.column("tp")
            inter, either = [], []
            for i, p in enumerate(ps):
                if p != last:
                    last, set_p = p, sets_of([tp[i].as_py() or ""], seed)[0]
                set_x = sets_of([tx[i].as_py() or ""], seed)[0]
                both = np.concatenate([set_x, set_p])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                inter.append(same), either.append(len(both) - same)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ps, pa.int64()), pa.array(inter, pa.int64()), pa.array(either, pa.int64())], names=["x", "p", "inter", "either"])

    return side_by_side(pairs, text).mapInArrow(work, "x long, p long, inter long, either long")


def side_by_side(pairs: DataFrame, text: DataFrame) -> DataFrame:
    """(x, p, tx, tp): both texts of each pair of classes."""
    one = pairs.join(text.select("x", F.col("text").alias("tx")), "x")
    two = one.join(text.select(F.col("x").alias("p"), F.col("text").alias("tp")), "p")
    return two.select("x", "p", "tx", "tp")


def differences(pairs: DataFrame, text: DataFrame, seed: int) -> DataFrame:
    """(x, p, e): the shingles that one of the two classes of each pair has and the other lacks."""

    def work(batches):
        last, set_p = None, None
        for batch in batches:
            xs, ps = batch.column("x").to_pylist(), batch.column("p").to_pylist()
            tx, tp = batch.column("tx"), batch.column("tp")
            for i, (x, p) in enumerate(zip(xs, ps, strict=True)):
                if p != last:
                    last, set_p = p, sets_of([tp[i].as_py() or ""], seed)[0]
                e = np.setxor1d(sets_of([tx[i].as_py() or ""], seed)[0], set_p, assume_unique=True).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()), pa.array([p], pa.int64()), pa.array([e], pa.list_(pa.int64()))], names=["x", "p", "e"])

    return side_by_side(pairs, text).mapInArrow(work, "x long, p long, e array<long>")


def linked_around(member: DataFrame, text: DataFrame, seed: int) -> DataFrame:
    """(a, b): the links of classes of different components among the members (x, p, n, pn, root, far) that are
    at most ``APART`` from their common pivot ``p``, but for classes that both link with it.

    Sizes of symmetric differences take the place of Jaccard: sets of n and m shingles link when
    (100 + PERCENT) * d <= (100 - PERCENT) * (n + m), where d = dx + dy - 2 * (common differences from the pivot).
    """
    up, down = 100 + PERCENT, 100 - PERCENT
    close = kept(member.filter(F.col("far") <= APART).select("x", "p", "n", "pn", "root").distinct())
    apart = kept(close.join(differences(close.select("x", "p"), text, seed), ["x", "p"]).withColumn("d", F.size("e").cast("long")))
    each = apart.select("p", "x", "root", F.explode("e").alias("e"))
    # only what several components have can be common to a pair that is looked for
    held = each.groupBy("p", "e").agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("p", "e", "df")
    rank = F.row_number().over(Window.partitionBy("p", "x").orderBy("df", "e"))
    count = F.count("*").over(Window.partitionBy("p", "x"))
    some = each.select("p", "x", "e").join(held, ["p", "e"]).select("p", "x", "e", rank.alias("rank"), count.alias("can"))
    row = some.join(apart.drop("e"), ["p", "x"])
    # of what a partner must have in common, the least: a class that links with the pivot needs one that does not, whose
    # distance from it is above the threshold; another's partners are at most 100 / PERCENT times its size
    near_p = up * F.col("d") <= down * (F.col("n") + F.col("pn"))
    with_far = up * F.col("d") + down * (F.col("pn") - F.col("n"))
    twice = F.when(near_p, with_far).otherwise(2 * (up * F.col("d") - down * F.floor(F.col("n") * up / PERCENT)))
    least = F.greatest(F.lit(1), F.ceil(twice / (2 * up)))
    row = row.withColumn("near_p", near_p).withColumn("rest", F.col("can") - F.col("rank"))
    row = kept(row.filter((F.col("can") >= least) & (F.col("rank") <= F.col("can") - least + 1)).select("p", "e", "x", "n", "d", "root", "near_p", "can", "rest"))
    other = row.select("p", "e", *(F.col(c).alias(f"q_{c}") for c in ("x", "n", "d", "root", "near_p", "can", "rest")))
    short = up * (F.col("d") + F.col("q_d")) - down * (F.col("n") + F.col("q_n"))  # 2 * up * what must be common
    meets = (F.col("x") < F.col("q_x")) & (F.col("root") != F.col("q_root")) & ~(F.col("near_p") & F.col("q_near_p"))
    # at the first common difference in the order, all other common ones come after it on both sides
    enough = 2 * up * (1 + F.least("rest", "q_rest")) >= short
    pairs = row.join(other, ["p", "e"]).filter(meets & compatible("n", "q_n") & enough)
    pairs = kept(pairs.select("p", "x", "q_x", short.alias("short")).distinct())
    one = pairs.join(apart.select("p", "x", "e"), ["p", "x"])
    two = one.join(apart.select("p", F.col("x").alias("q_x"), F.col("e").alias("q_e")), ["p", "q_x"])
    return two.filter(2 * up * F.size(F.array_intersect("e", "q_e")) >= F.col("short")).select(F.col("x").alias("a"), F.col("q_x").alias("b"))


def lonely(text: DataFrame, seed: int) -> DataFrame:
    """(x, own): how many shingles of each class no other class of ``text`` has."""

    def work(batches):
        for batch in by_text(batches):
            sets = sets_of(texts_of(batch), seed)
            x = np.repeat(batch.column("x").to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.concatenate(sets).view(np.int64))], names=["x", "s"])

    each = text.select("x", "text").mapInArrow(work, "x long, s long")
    return each.groupBy("s").agg(F.count("*").alias("df"), F.min("x").alias("x")).filter("df = 1").groupBy("x").agg(F.count("*").alias("own"))


def unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the regions whose members are in several components, with the component as ``root``."""
    now = members.drop("root").join(roots.select(F.col("node").alias("x"), "root"), "x", "left").withColumn("root", F.coalesce("root", "x"))
    mixed_ = now.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("s")
    return now.join(mixed_, "s")


def links(docs: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """Every document's (doc_id, n, x), (node, root) of the classes that are linked with others, and the
    hash seed of ``x``."""
    rows = modest_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    first = kept(first_pass(rows, seed))
    each = first.filter("slice is null").select("doc_id", "n", "x", "y")
    classes = kept(each.filter("n > 0").groupBy("x").agg(F.min("doc_id").alias("doc_id"), F.min("y").alias("y"), F.max("y").alias("y2")))
    if classes.filter("y <> y2").limit(1).count():  # two different sets have one key: hash anew
        return links(docs, seed + 1)
    level = levels(first.filter("slice is not null").select("slice", "counts"))
    blocks = kept(regions(rows, level, seed))
    member = blocks.select("x", "n", F.explode("rare").alias("s"))
    place = F.xxhash64("x", F.lit(1)).cast("double") / F.lit(2.0**64) + 0.5  # the order in which members become pivots
    shared = member.groupBy("s").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).filter("lo <> hi").select("s")
    member = member.join(shared, "s").distinct()
    # a class needs as many shared ones as the smallest set that can reach the threshold with it: chance hits are fewer
    member = member.withColumn("both", F.count("*").over(Window.partitionBy("x")))
    member = member.filter(F.col("both") > F.floor(F.floor(F.col("n") * PERCENT / 100) / MORE))
    # the part of them that is shared is largest in the middle of near copies
    mine = 1 - F.col("both") / (F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 + F.floor(F.col("n") / MORE))
    member = kept(member.select("x", "n", "s", place.alias("u"), mine.alias("mine")))
    elected = member.groupBy("s").agg(F.min(F.struct("mine", "u", "x", "n")).alias("p"), F.count("*").alias("m"))
    member = member.drop("mine")
    member = member.join(elected.select("s", F.col("p.x").alias("p"), F.col("p.n").alias("pn"), "m"), "s")
    pairs = kept(member.filter("x <> p").filter(compatible("n", "pn")).select("x", "p").distinct())
    text = texts(rows, pairs, classes, seed)
    near = kept(compared(pairs, text, seed))
    linked = near.filter(f"inter * 100 >= either * {PERCENT}").select(F.col("x").alias("a"), F.col("p").alias("b"))
    roots = kept(components(linked))
    # distances to the region's pivot give the windows of the later rounds; the pivot itself is done there
    far = near.select("x", "p", (1 - F.col("inter") / F.col("either")).alias("far"))
    member = kept(unsettled(member.filter("x <> p").join(far, ["x", "p"], "left"), roots))
    # regions with the same members say the same: one of them is enough
    alike = member.groupBy("s").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("x")).alias("h1"), F.bit_xor(F.xxhash64("x", F.lit(2))).alias("h2"))
    one = alike.groupBy("k", "h1", "h2").agg(F.min("s").alias("s"))
    member = kept(member.join(one.select("s"), "s"))
    # what no other open class has is in no intersection: it bounds overlaps, and rules some classes out
    open_ = kept(member.select("x").distinct())
    text = text.unionByName(texts(rows, open_.select("x", F.col("x").alias("p")), classes, seed, text))
    own = lonely(text.join(open_, "x", "left_semi"), seed)
    member = member.join(own, "x", "left").withColumn("can", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
    member = kept(member.filter(F.col("can") * 100 >= F.col("n") * PERCENT))
    around = linked_around(member, text, seed)
    old = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = kept(components(around.unionByName(old)))
    # what is left for the regions: pairs of which one is far from the pivot, and the other not much nearer
    step = 1 - PERCENT / 100 + 1e-9
    out = F.coalesce(F.col("far") > APART, F.lit(True))
    member = member.withColumn("out", out).filter(F.coalesce(F.col("far") > APART - step, F.lit(True)))
    member = kept(unsettled(member, roots))
    most = member.agg(F.max("m")).first()[0] or 0
    share, full = 1, not most
    while not full:
        share, tried = share * GROWTH, share
        full = share >= most
        # pivots of this round: members whose place is among the first ``share`` of the region, in expectation
        part = F.col("u") * F.col("m")
        chosen = member.filter(part >= tried if tried > 1 else part >= 0)
        chosen = chosen if full else chosen.filter(part < share)
        chosen = chosen.select("s", F.col("out").alias("q_out"), F.col("x").alias("q"), F.col("n").alias("qn"), F.col("u").alias("q_u"), F.col("root").alias("q_root"), F.col("far").alias("q_far"), F.col("can").alias("q_can"))
        over = F.least("can", "q_can")
        bound = over * 100 >= (F.col("n") + F.col("qn") - over) * PERCENT
        window = F.coalesce(F.abs(F.col("far") - F.col("q_far")) <= step, F.lit(True))
        # each pair once: with the pivot that comes first in the order, in that one's round
        once = (F.col("u") > F.col("q_u")) | ((F.col("u") == F.col("q_u")) & (F.col("x") > F.col("q")))
        meet = member.join(chosen, "s").filter((F.col("root") != F.col("q_root")) & compatible("n", "qn") & bound & once & window & (F.col("out") | F.col("q_out")))
        pairs = kept(meet.select("x", F.col("q").alias("p")).distinct())
        text = text.unionByName(texts(rows, pairs, classes, seed, text))
        more = compared(pairs, text, seed).filter(f"inter * 100 >= either * {PERCENT}").select(F.col("x").alias("a"), F.col("p").alias("b"))
        old = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = kept(components(more.unionByName(old)))
        if not full:
            member = kept(unsettled(member, roots))
            full = not member.limit(1).count()
    return each, roots, seed


def texts(rows: DataFrame, pairs: DataFrame, classes: DataFrame, seed: int, have: DataFrame | None = None) -> DataFrame:
    """(x, text) of the classes in ``pairs`` that ``have`` lacks. A bit map of fixed size over hashed ids
    thins the scan before texts are shuffled; where it is full, all texts are."""
    wanted = pairs.select("x").unionByName(pairs.select(F.col("p").alias("x"))).distinct()
    if have is not None:
        wanted = wanted.join(have, "x", "left_anti")
    wanted = kept(wanted.join(classes.select("x", "doc_id"), "x"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITS))
    bits = np.zeros((1 << BITS) // 8, np.uint8)
    parts = wanted.select((place + 1).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("b"))
    for r in parts.collect():  # at most 2 ** BITS bits, in buckets of 32768 from number 1
        at = (r.k - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(r.b, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def thin(batches):
        known = shared.value
        for batch in batches:
            h = batch.column("h").to_numpy()
            yield batch.filter(pa.array((known[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1)).select(["id", "text"])

    some = rows.select(F.col("doc_id").alias("id"), "text", place.alias("h")).mapInArrow(thin, "id long, text string")
    return kept(of_class(some.join(wanted, F.col("id").eqNullSafe(F.col("doc_id"))), seed))


def of_class(by_id: DataFrame, seed: int) -> DataFrame:
    """(x, text): one text of each wanted class; a repeated id may bring texts of other classes."""

    def work(batches):
        for batch in by_text(batches):
            own = [key_of(s, 0) for s in sets_of(texts_of(batch), seed)]
            here = pa.array(np.array(own, np.int64) == batch.column("x").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(here), batch.column("text").filter(here)], names=["x", "text"])

    found = by_id.select("x", "text").mapInArrow(work, "x long, text string")
    return found.groupBy("x").agg(F.min("text").alias("text"))


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    return grouped(docs)[0].drop("x")


def grouped(docs: DataFrame) -> tuple[DataFrame, int]:
    """``join`` with the key ``x`` of each document's set, and the key's seed."""
    each, roots, seed = links(docs)
    classes = each.groupBy("x").agg(F.min("doc_id").alias("low"), F.max("n").alias("n"))
    rooted = classes.join(roots.select(F.col("node").alias("x"), "root"), "x", "left").withColumn("root", F.coalesce("root", "x"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_class = rooted.filter("n > 0").join(lowest, "root").select("x", "component_id")
    out = each.join(by_class, "x", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "x"), seed


def representatives(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each component, with all its columns; of rows that repeat an
    id within a component, one. Documents without words stay."""
    rows, seed = grouped(docs)
    found = rows.filter("doc_id <=> component_id").groupBy("doc_id", "component_id", "n_shingles").agg(F.min("x").alias("x"))
    own, key, hit, n, place, id_ = fresh(docs, "_own", "_key", "_hit", "_n", "_place", "_id")
    stay = found.groupBy("doc_id", "x").agg(F.max("n_shingles").alias("n")).select(F.col("doc_id").alias(own), F.col("x").alias(hit), F.col("n").alias(n))
    by_place = plain_names(docs)
    schema = by_place.select("*", F.lit(0).cast("long").alias("key")).schema

    def keyed(batches):
        for batch in by_text(batches):
            x = pa.array([key_of(s, 0) for s in sets_of(texts_of(batch), seed)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, x], names=[*batch.schema.names, "key"])

    with_id = by_place.mapInArrow(keyed, schema).toDF(*docs.columns, key).withColumn(id_, F.col("doc_id").cast("long"))
    both = with_id.join(stay, F.col(id_).eqNullSafe(F.col(own)) & (F.col(key) == F.col(hit)))
    turn = F.row_number().over(Window.partitionBy(own, hit).orderBy(F.length("text").desc()))
    return both.withColumn(place, turn).filter((F.col(place) == 1) | (F.col(n) == 0)).select(*named(docs))


@query("op8_jaccard_join")
def op8(spark, sf_dir):
    return join(table(spark, sf_dir, "documents"))
