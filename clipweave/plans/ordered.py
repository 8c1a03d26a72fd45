"""Ordered (per-timeline) window work that survives one timeline holding most rows.

A plain ``Window.partitionBy(clip)`` puts one clip in one task, which is right for all clips but the few that are
too long for it. `Blocks` names those few in a small table; `by_size` runs an operator on them in time blocks and on
all the others plainly, so how one clip is planned never depends on another. In blocks, the window runs inside
(clip, block), and what crosses a block edge (previous row, running total, halo values) travels through a table with
one row per block. Both plans return the same rows.
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut

BLK = "_blk"


@dataclass(frozen=True)
class Blocks:
    """Width of a time block, in units of the first order column, and the keys that are cut into blocks (a table
    with one row per long key; None: all of them)."""

    width: int
    hot: DataFrame | None = None

    @staticmethod
    def measure(df: DataFrame, key: Sequence[str], t: str, limit: int = 2_000_000) -> "Blocks | None":
        """The keys of more than ``limit`` rows, with a width that keeps their densest block under it; None
        when there are none. Only a few scalars reach the driver."""
        per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), (F.max(t) - F.min(t)).alias("span"))
        hot = cut(per_key.where(F.col("n") > limit))  # as many rows as there are long keys
        n, span = hot.agg(F.max("n"), F.max_by("span", "n")).first()
        if n is None:
            return None
        hot = hot.select(*key)
        long = df.join(hot, list(key), "left_semi")
        width = max(1, int(span * limit / n))
        while width > 1:
            densest = (
                long.groupBy(*key, F.floor(F.col(t) / width).alias(BLK)).count().agg(F.max("count")).first()[0]
            )
            if densest <= limit:
                break
            width = max(1, width // (2 * -(-densest // limit)))
        return Blocks(width, hot)

    def scaled(self, factor: int) -> "Blocks":
        """The same keys where times are ``factor`` times as large."""
        return Blocks(self.width * factor, self.hot)

    def wide(self, width: int) -> "Blocks":
        """The same keys, ordered by something else that needs blocks of ``width``."""
        return Blocks(width, self.hot)

    def apart(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of the ordinary keys and of the long ones (``df`` twice if it has no such key)."""
        if not set(self.hot.columns) <= set(df.columns):
            return df, df
        return df.join(self.hot, self.hot.columns, "left_anti"), df.join(self.hot, self.hot.columns, "left_semi")


def by_size(fn):
    """An operator with ``blocks`` whose rows depend on rows of their own key only: run plainly on the ordinary
    keys and in blocks on the long ones."""
    names = inspect.signature(fn)

    @functools.wraps(fn)
    def run(*args, **kw):
        given = names.bind(*args, **kw)
        given.apply_defaults()
        blocks = given.arguments["blocks"]
        if blocks is None or blocks.hot is None:
            return fn(*args, **kw)
        small, long = dict(given.arguments), dict(given.arguments)
        for name, value in given.arguments.items():
            if isinstance(value, DataFrame):
                small[name], long[name] = blocks.apart(value)
        small["blocks"], long["blocks"] = None, Blocks(blocks.width)
        return fn(**small).unionByName(fn(**long))

    return run


def _own_size(method):
    """The same for the methods of `Ordered` whose first argument is the rows."""

    @functools.wraps(method)
    def run(self, df, *args, **kw):
        blocks = self.blocks
        if blocks is None or blocks.hot is None:
            return method(self, df, *args, **kw)
        small, long = blocks.apart(df)
        plain, cut_up = Ordered(self.key, self.order), Ordered(self.key, self.order, Blocks(blocks.width))
        return method(plain, small, *args, **kw).unionByName(method(cut_up, long, *args, **kw))

    return run


class Ordered:
    """Rows of ``key`` in the total order ``order``; ``blocks`` splits long keys."""

    def __init__(self, key: Sequence[str], order: Sequence[str], blocks: Blocks | None = None):
        self.key, self.order, self.blocks = list(key), list(order), blocks

    # -- plumbing ---------------------------------------------------------------------------
    def _with_block(self, df: DataFrame) -> DataFrame:
        if self.blocks is None:
            return df
        # the rows are read twice below, by the local window and by the block summary; in a chain
        # of operators that would double the work at each step, so the input is written once
        return cut(df).withColumn(BLK, F.floor(F.col(self.order[0]) / F.lit(self.blocks.width)).cast("long"))

    @property
    def part(self) -> list[str]:
        return self.key + ([BLK] if self.blocks else [])

    def _local(self):
        return Window.partitionBy(*self.part).orderBy(*self.order)

    def _ord(self) -> Column:
        return F.struct(*self.order)

    def _join_blocks(self, df: DataFrame, summary: DataFrame) -> DataFrame:
        return df.join(summary, self.part, "left")

    # -- previous / next row ----------------------------------------------------------------
    @_own_size
    def neighbours(
        self, df: DataFrame, prev: Mapping[str, Column | str] = {}, next: Mapping[str, Column | str] = {}
    ) -> DataFrame:
        """Add columns holding values of the previous / next row (NULL at the ends)."""
        keep = df.columns
        df = self._with_block(df)
        pack = lambda m: F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in m.items()])
        w = self._local()
        work, sides = df, []
        if prev:
            work = work.withColumn("_p", F.lag(pack(prev)).over(w))
            sides.append(("_p", prev))
        if next:
            work = work.withColumn("_n", F.lead(pack(next)).over(w))
            sides.append(("_n", next))
        if self.blocks is not None:
            edge = []
            if prev:
                edge.append(F.max_by(pack(prev), self._ord()).alias("_pe"))
            if next:
                edge.append(F.min_by(pack(next), self._ord()).alias("_ne"))
            wb = Window.partitionBy(*self.key).orderBy(BLK)
            summary = df.groupBy(*self.part).agg(*edge)
            picks = []
            if prev:
                picks.append(F.lag("_pe").over(wb).alias("_pe"))
            if next:
                picks.append(F.lead("_ne").over(wb).alias("_ne"))
            work = self._join_blocks(work, summary.select(*self.part, *picks))
            for c, e in (("_p", "_pe"), ("_n", "_ne")):
                if c in work.columns:
                    work = work.withColumn(c, F.coalesce(c, e))
        return work.select(*keep, *[F.col(f"{c}.{n}").alias(n) for c, m in sides for n in m])

    # -- running / whole-key aggregates -----------------------------------------------------
    _MERGE = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}

    def _agg(self, kind: str, c: Column) -> Column:
        if kind == "last":
            return F.max_by(c, F.when(c.isNotNull(), self._ord()))
        return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind](c)

    @_own_size
    def running(
        self, df: DataFrame, spec: Mapping[str, tuple[str, Column | str]], exclusive: bool = False
    ) -> DataFrame:
        """Running sum / count / max / min / last non-NULL, from the first row to this one
        (or the one before, when ``exclusive``)."""
        keep = df.columns
        df = self._with_block(df)
        w = self._local().rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
        wb = Window.partitionBy(*self.key).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
        spec = {n: (k, F.col(c) if isinstance(c, str) else c) for n, (k, c) in spec.items()}

        def local(kind, c):
            if kind == "last":
                return F.last(c, ignorenulls=True).over(w)
            return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind](c).over(w)

        work = df.select("*", *[local(k, c).alias(f"_l_{n}") for n, (k, c) in spec.items()])
        if self.blocks is not None:
            tot = df.groupBy(*self.part).agg(*[self._agg(k, c).alias(f"_t_{n}") for n, (k, c) in spec.items()])
            offs = [
                (F.last(f"_t_{n}", ignorenulls=True) if k == "last" else self._MERGE[k](f"_t_{n}"))
                .over(wb)
                .alias(f"_o_{n}")
                for n, (k, _) in spec.items()
            ]
            work = self._join_blocks(work, tot.select(*self.part, *offs))
            merge = {
                "sum": lambda l, o: F.when(l.isNull() & o.isNull(), None).otherwise(
                    F.coalesce(l, F.lit(0)) + F.coalesce(o, F.lit(0))
                ),
                "count": lambda l, o: F.coalesce(l, F.lit(0)) + F.coalesce(o, F.lit(0)),
                "max": F.greatest,
                "min": F.least,
                "last": F.coalesce,
            }
            out = [merge[k](F.col(f"_l_{n}"), F.col(f"_o_{n}")).alias(n) for n, (k, _) in spec.items()]
        else:
            out = [F.col(f"_l_{n}").alias(n) for n in spec]
        return work.select(*keep, *out)

    @_own_size
    def totals(self, df: DataFrame, spec: Mapping[str, tuple[str, Column | str]]) -> DataFrame:
        """Whole-key sum / count / max / min beside every row."""
        keep = df.columns
        df = self._with_block(df)
        spec = {n: (k, F.col(c) if isinstance(c, str) else c) for n, (k, c) in spec.items()}
        if self.blocks is None:
            w = Window.partitionBy(*self.key)
            return df.select("*", *[self._agg(k, c).over(w).alias(n) for n, (k, c) in spec.items()])
        tot = df.groupBy(*self.part).agg(*[self._agg(k, c).alias(n) for n, (k, c) in spec.items()])
        wk = Window.partitionBy(*self.key)
        tot = tot.select(*self.part, *[self._MERGE[k](n).over(wk).alias(n) for n, (k, _) in spec.items()])
        return self._join_blocks(df, tot).select(*keep, *spec)

    @_own_size
    def number(self, df: DataFrame, name: str, start: int = 0) -> DataFrame:
        """Row number in order, from ``start``."""
        if self.blocks is None:
            return df.withColumn(name, F.row_number().over(self._local()).cast("long") + (start - 1))
        return self.running(df, {name: ("count", F.lit(1))}).withColumn(name, F.col(name) + (start - 1))

    # -- sliding frames ---------------------------------------------------------------------
    @_own_size
    def rolling(self, df: DataFrame, out: str, value: Column | str, before: int, after: int) -> DataFrame:
        """Array of ``struct(v)`` for the rows from ``before`` back to ``after`` ahead."""
        keep = df.columns
        df = self._with_block(df)
        v = F.col(value) if isinstance(value, str) else value
        w = self._local()
        work = df.withColumn("_w", F.collect_list(F.struct(v.alias("v"))).over(w.rowsBetween(-before, after)))
        if self.blocks is not None:
            back = Window.partitionBy(*self.part).orderBy(*[F.desc(o) for o in self.order])
            work = work.withColumn("_r", F.row_number().over(w)).withColumn("_rr", F.row_number().over(back))
            ranked = (
                df.select(*self.part, *[o for o in self.order if o not in self.part], v.alias("_v"))
                .withColumn("_r", F.row_number().over(w))
                .withColumn("_rr", F.row_number().over(back))
                .where((F.col("_r") <= after) | (F.col("_rr") <= before))
            )
            item = F.struct(F.col("_r").alias("r"), F.col("_v").alias("v"))
            strip = lambda a: F.transform(F.sort_array(a), lambda x: F.struct(x["v"].alias("v")))
            summary = ranked.groupBy(*self.part).agg(
                strip(F.collect_list(F.when(F.col("_rr") <= before, item))).alias("_tail"),
                strip(F.collect_list(F.when(F.col("_r") <= after, item))).alias("_head"),
            )
            wb = Window.partitionBy(*self.key).orderBy(BLK)
            summary = summary.select(
                *self.part,
                F.flatten(F.collect_list("_tail").over(wb.rowsBetween(-max(before, 1), -1))).alias("_prev"),
                F.flatten(F.collect_list("_head").over(wb.rowsBetween(1, max(after, 1)))).alias("_next"),
            )
            need_b = F.greatest(F.lit(0), F.least(F.lit(before) - (F.col("_r") - 1), F.size("_prev")))
            need_a = F.greatest(F.lit(0), F.least(F.lit(after) - (F.col("_rr") - 1), F.size("_next")))
            work = self._join_blocks(work, summary).withColumn(
                "_w",
                F.concat(
                    F.slice("_prev", F.size("_prev") - need_b + 1, need_b), "_w", F.slice("_next", F.lit(1), need_a)
                ),
            )
        return work.select(*keep, F.col("_w").alias(out))

    # -- gaps and islands -------------------------------------------------------------------
    @_own_size
    def islands(self, df: DataFrame, same: Mapping[str, Column], name: str = "run") -> DataFrame:
        """Number maximal stretches of rows whose ``same`` expressions are all equal (NULL-safe)."""
        keep = df.columns
        df = self._with_block(df.select("*", F.struct(*[c.alias(n) for n, c in same.items()]).alias("_k")))
        w = self._local()
        first = F.lag(F.lit(True)).over(w).isNull()
        work = df.withColumn("_brk", first | ~F.col("_k").eqNullSafe(F.lag("_k").over(w)))
        count = F.sum(F.col("_brk").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
        work = work.withColumn(name, count)
        if self.blocks is None:
            return work.select(*keep, name)
        # a block's first row always counts as a break inside it; it is none where the block before ends alike
        edge = work.groupBy(*self.part).agg(F.max(name).alias("_n"), F.min_by("_k", self._ord()).alias("_head"), F.max_by("_k", self._ord()).alias("_tail"))
        wb = Window.partitionBy(*self.key).orderBy(BLK)
        joined = F.coalesce(F.lag(F.lit(True)).over(wb) & F.col("_head").eqNullSafe(F.lag("_tail").over(wb)), F.lit(False))
        edge = edge.select(*self.part, "_n", joined.cast("long").alias("_same"))
        before = F.coalesce(F.sum(F.col("_n") - F.col("_same")).over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        edge = edge.select(*self.part, (before - F.col("_same")).alias("_off"))
        return self._join_blocks(work, edge).select(*keep, (F.col(name) + F.col("_off")).alias(name))
