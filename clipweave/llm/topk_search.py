"""Exact top-k inner products by no-random-access aggregation (operator 10).

Candidates and queries are packed into blocks, and every pair of blocks is one task's work. Inside a
candidate block each component is a list sorted by its contribution; lists are read in step, deeper and
deeper. What was read of a candidate gives a lower bound, and the last value read of each list bounds
what was not read. Candidates whose upper bound is below the k-th lower
bound are out; when few are left, or the lists are read, the finalists' scores are resolved exactly. Blocks
give k rows a query, and the best k of those remain.

Defined cases: vectors that are null or hold a null or non-finite component take no part (an empty
vector has score 0 with all); shorter vectors count as ending in zeros; a query never meets rows of its
own id; ties go to the smaller id; repeated ids stay separate candidates, and as a
query the smallest vector stands for its id; without rows the result is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, query, table


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with floor(256 * x) of each component, as whole numbers."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * 256).cast("long"))
    return vectors.filter(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), whole.alias("v"))


def matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    """Rows padded with zeros to ``width``."""
    length = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(length), width), kind)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(length)), length)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


class Lists:
    """The sorted lists of a candidate block, read for many queries in step."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.sorted = np.sort(x, axis=0)  # per component, smallest first

    def bounds(self, q: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (queries x candidates) once each list is read to ``depth`` from the end at
        which it contributes most: an unread component lies between the list's last value and its worst."""
        x, s = self.x, self.sorted
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        front_up, front_down = s[len(x) - depth], s[depth - 1]
        upper = up @ np.maximum(x, front_up).T + down @ np.minimum(x, front_down).T
        lower = up @ np.where(x >= front_up, x, s[0]).T + down @ np.where(x <= front_down, x, s[-1]).T
        return lower, upper

    def top(self, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) of the best k candidates of each query, by place."""
        n, todo, found = len(self.x), np.arange(len(q)), []
        depth = min(n, max(64, n // 16))
        while len(todo):
            lower, upper = self.bounds(q[todo], depth)
            other = self.ids[None] != own[todo][:, None]
            lower = np.where(other, lower, -np.inf)
            bar = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(todo), -np.inf)
            alive = other & (upper >= bar[:, None])  # nobody else can reach the k-th lower bound
            ready = alive.sum(1) <= max(4 * k, n // 16) if depth < n else np.ones(len(todo), bool)
            i, j = np.nonzero(alive[ready])
            i = todo[ready][i]
            score = np.einsum("pd,pd->p", q[i], self.x[j])
            order = np.lexsort((self.ids[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            first = np.concatenate([[0], np.flatnonzero(i[1:] != i[:-1]) + 1]) if len(i) else np.empty(0, int)
            turn = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
            found.append((i[turn < k], j[turn < k], score[turn < k]))
            todo, depth = todo[~ready], min(n, depth * 4)
        i, j, score = (np.concatenate(c) for c in zip(*found, strict=True))
        return i, j, score


def search(vectors: DataFrame, is_query, k: int = 5, per_block: int = 4096, per_ask: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row for which ``is_query`` holds.

    Blocks hold ``per_block`` candidates and ``per_ask`` queries on average, whatever the size of the table; every
    pair of blocks meets once."""
    rows = kept(usable(vectors))
    count = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max(F.size("v")).alias("d"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, c: F.greatest(a, F.abs(c)))).alias("top")).first()
    width = count.d or 0
    # doubles hold all sums exactly unless components are huge
    kind = np.float64 if width * (count.top or 0) ** 2 < 2**52 else np.int64
    n_blocks, n_asks = max(1, -(-count.n // per_block)), max(1, -(-count.q // per_ask))
    spread = F.monotonically_increasing_id()  # rows of one id, however many, go to different blocks
    c = rows.withColumn("block", F.pmod(F.xxhash64(spread), F.lit(n_blocks)).cast("int")).withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(n_asks - 1))))
    asks = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    q = asks.withColumn("ask", F.pmod(F.xxhash64(spread), F.lit(n_asks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        ids = left.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        lists = Lists(ids[order], matrix(left.column("v").combine_chunks(), width, kind)[order])
        asked = right.column("vec_id").to_numpy()
        what = matrix(right.column("v").combine_chunks(), width, kind)
        i, j, score = lists.top(what, asked, k)
        return pa.table([pa.array(asked[i]), pa.array(lists.ids[j]), pa.array(score.astype(np.int64))], names=names)

    per_pair = c.groupBy("block", "ask").cogroup(q.groupBy("block", "ask")).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return per_pair.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op10_topk_search")
def op10(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
