"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# name -> callable(spark, sf_dir), and the SQL of those that SQL can express
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only in local mode where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def kept(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back: later branches read the
    files, and a lost executor costs no recomputation of what went before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def modest_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, in a session whose Arrow batches hold at most ``rows`` rows: texts are long, and both the JVM and the
    Python side hold whole batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


def by_text(batches: Iterator[pa.RecordBatch], chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``chars`` bytes of ``text``, so that what Python holds at
    once stays bounded whatever the lengths of the documents; one document is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column("text")
        if isinstance(size, pa.ChunkedArray):
            size = size.combine_chunks()
        lengths = pc.fill_null(pc.binary_length(size), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if held and held + n > chars:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def crc_bucket(column: str, n: int):
    """crc32 of the id written in decimal, modulo ``n``; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(df: DataFrame) -> list:
    """All columns of ``df``, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def plain_names(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by place, but for ``text``; Arrow functions take no dots in names."""
    return df.toDF(*(c if c == "text" else f"c{i}" for i, c in enumerate(df.columns)))
