"""Ordered folds: steps that depend on the previous *output*, not the previous row.

The fold is a small Python generator over rows in order.  Spark shuffles and sorts; the task
streams sorted Arrow batches, so no group is ever held in memory.  Where the data has points at
which the fold starts afresh whatever came before (``reset``), each stretch between such points
becomes its own group, which spreads a long clip over many tasks without changing the result.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import Blocks, Ordered

_ARROW = {
    T.LongType(): pa.int64(),
    T.IntegerType(): pa.int32(),
    T.DoubleType(): pa.float64(),
    T.StringType(): pa.string(),
    T.BooleanType(): pa.bool_(),
}


def ordered_fold(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    out: str,
    fold: Callable[[Iterable[tuple]], Iterator[tuple]],
    reset: Column | None = None,
    blocks: Blocks | None = None,
) -> DataFrame:
    """Run ``fold`` over the rows (``cols``, in ``order``) of each key; it yields tuples matching
    the DDL string ``out``.  ``reset`` marks rows before which the fold may start afresh."""
    key, order, cols = list(key), list(order), list(cols)
    group = key
    if blocks is not None and reset is not None:
        df = df.withColumn("_reset", F.coalesce(reset, F.lit(False)).cast("long"))
        df = Ordered(key, order, blocks).running(df, {"_stretch": ("sum", "_reset")})
        group = key + ["_stretch"]
    src = df.select(*group, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"_c{i}") for i, c in enumerate(cols)])
    out_schema = T.StructType([src.schema[k] for k in key] + T._parse_datatype_string(out).fields)
    arrow = pa.schema([pa.field(f.name, _ARROW[f.dataType]) for f in out_schema.fields])
    ng, nk, skip = len(group), len(key), len(group) + len(order)

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(*[c.to_pylist() for c in b.columns])

        buf: list[tuple] = []
        emit = lambda: pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*buf), arrow)], schema=arrow
        )
        for g, it in itertools.groupby(rows(), key=lambda r: r[:ng]):
            for o in fold(r[skip:] for r in it):
                buf.append(g[:nk] + o)
                if len(buf) >= 8192:
                    yield emit()
                    buf = []
        if buf:
            yield emit()

    arranged = src.repartition(*group).sortWithinPartitions(*group, *[f"_o{i}" for i in range(len(order))])
    return arranged.mapInArrow(run, out_schema)
