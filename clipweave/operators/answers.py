"""Conformance of annotator answers, and the pluggable annotator itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..plans.cut import cut
from ..schemas import Answer


def check_answer(df: DataFrame, col: str, shape: Answer, strict: bool = False) -> DataFrame:
    """Parse ``col`` and say why it does not conform: ``answer`` (struct) and ``problem`` (NULL if fine).
    ``strict`` wants every key present and no other key."""
    body = X.strip_code_fence(col)
    schema = T._parse_datatype_string(shape.ddl)
    df = df.withColumn("_body", body).withColumn("answer", F.from_json("_body", schema, {"mode": "PERMISSIVE"}))
    keys = F.coalesce(F.json_object_keys("_body"), F.array().cast("array<string>"))
    want = [f.name for f in schema.fields] if strict else list(shape.required)
    lit = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    problem = F.when(F.get_json_object("_body", "$").isNull() | F.json_object_keys("_body").isNull(), "not a JSON object")
    problem = problem.when(F.size(F.array_except(lit(want), keys)) > 0, F.concat(F.lit("missing "), F.array_join(F.array_except(lit(want), keys), ", ")))
    if strict:
        extra = F.array_except(keys, lit([f.name for f in schema.fields]))
        problem = problem.when(F.size(extra) > 0, F.concat(F.lit("unexpected "), F.array_join(extra, ", ")))
    for name in shape.required:
        problem = problem.when(F.col(f"answer.{name}").isNull(), F.lit(f"bad {name}"))
    for name, need in shape.items.items():
        problem = problem.when(F.coalesce(F.exists(F.col(f"answer.{name}"), _lacks(need)), F.lit(False)), F.lit(f"incomplete item in {name}"))
    for path, allowed in shape.enums.items():
        head, _, tail = path.partition(".")
        if tail:
            off = F.exists(F.col(f"answer.{head}"), _outside(tail, allowed))
        else:
            off = ~F.col(f"answer.{head}").isin(*allowed)
        problem = problem.when(F.coalesce(off, F.lit(False)), F.lit(f"value of {path} not allowed"))
    return df.withColumn("problem", problem).drop("_body")


def _lacks(keys: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda x: reduce(lambda a, b: a | b, [x[k].isNull() for k in keys])


def _outside(key: str, allowed: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda x: ~x[key].isin(*allowed)


def split_answers(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected)"""
    return checked.where(F.col("problem").isNull()).drop("problem"), checked.where(F.col("problem").isNotNull())


class RowsFailed(Exception):
    """Raised by an annotator that failed on some rows only: ``errors`` maps their places in the batch to messages,
    ``answers`` holds the added columns of all rows (whatever it likes at the failed places)."""

    def __init__(self, errors: dict[int, str], answers: pd.DataFrame):
        super().__init__(f"{len(errors)} rows failed")
        self.errors, self.answers = errors, answers


def annotate(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], key: list[str], schema: str) -> DataFrame:
    """Run a user's ``fn(batch) -> batch`` over rows in Arrow batches.  ``schema`` (DDL) describes the
    columns ``fn`` adds.  Rows that fail come back with NULLs and the message in ``error``, the others with their
    answers. ``fn`` says which rows failed by an ``error`` column of its own or by `RowsFailed`; then nothing is asked
    again but, after `RowsFailed`, those rows, once and alone. After any other exception no answer of the batch is
    known, and its rows are asked once more, one by one. Results keep ``key`` so order never matters."""
    added = T._parse_datatype_string(schema)
    out = T.StructType([df.schema[k] for k in key] + added.fields + [T.StructField("error", T.StringType())])
    names = [f.name for f in added.fields]

    def table(batch: pd.DataFrame, answers: dict[str, list], errors: list) -> pd.DataFrame:
        res = batch[key].copy()
        for n in names:
            clear = [None if e is not None else v for v, e in zip(answers[n], errors, strict=True)] if any(e is not None for e in errors) else answers[n]
            res[n] = pd.Series(clear, index=res.index, dtype=object)
        res["error"] = pd.Series(errors, index=res.index, dtype=object)
        return res

    def asked(batch: pd.DataFrame) -> tuple[dict[str, list], list]:
        got = fn(batch)
        own = got["error"] if "error" in got.columns and "error" not in names else [None] * len(batch)
        return {n: list(got[n]) for n in names}, [None if pd.isna(e) else str(e) for e in own]

    def alone(batch: pd.DataFrame, i: int) -> tuple[dict[str, list], list]:
        try:
            return asked(batch.iloc[i : i + 1].reset_index(drop=True))
        except Exception as e:  # noqa: BLE001 - the annotator is foreign code
            message = e.errors.get(0, str(e)) if isinstance(e, RowsFailed) else f"{type(e).__name__}: {e}"
            return {n: [None] for n in names}, [message]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.reset_index(drop=True)
            try:
                answers, errors = asked(b)
            except Exception as e:  # noqa: BLE001
                known = isinstance(e, RowsFailed)
                answers = {n: list(e.answers[n]) if known else [None] * len(b) for n in names}
                errors = [None] * len(b)
                for i in sorted(e.errors) if known else range(len(b)):
                    one, (errors[i],) = alone(b, i) if known or len(b) > 1 else ({n: [None] for n in names}, [f"{type(e).__name__}: {e}"])
                    for n in names:
                        answers[n][i] = one[n][0]
            yield table(b, answers, errors)

    return df.mapInPandas(run, out)


def question(df: DataFrame, inputs: list[str], version: str) -> Column:
    """What an annotator is asked: a hash of the input columns and of the annotator's version."""
    return F.sha2(F.concat_ws("\n", F.lit(version), F.to_json(F.struct(*[F.col(c) for c in inputs]), {"ignoreNullFields": "false"})), 256)


def stored_answers(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """All answers kept under ``store`` (none where nothing is there yet)."""
    ddl = f"question string, {schema}, run string"
    try:
        return spark.read.schema(ddl).parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


def ask_once(
    df: DataFrame, fn, key: list[str], inputs: list[str], schema: str, store: str, run: str, version: str = "1", shape: Answer | None = None, raw: str = "answer"
) -> tuple[DataFrame, DataFrame]:
    """(rows with answers, rejects): the annotator is asked only what ``store`` has no answer to, and each different
    question once, however many rows put it.

    New answers without error are kept as partition ``run`` of the store, which a repeated run replaces; ``shape`` keeps
    only those whose column ``raw`` conforms (F32). The rows carry ``key``, the added columns and ``error``; rejects are
    the new questions that failed or did not conform, with ``problem``; they are asked again by the next run."""
    spark = df.sparkSession
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    asks = df.select(*key, *[c for c in inputs if c not in key], question(df, inputs, version).alias("question"))
    known = stored_answers(spark, store, schema).where(F.col("run") != run).select("question", *names).dropDuplicates(["question"])
    new = asks.select("question", *inputs).dropDuplicates(["question"]).join(known.select("question"), "question", "left_anti")
    got = annotate(new, fn, ["question"], schema)
    if shape:  # under names that the check does not use itself
        cols = ["question", *names, "error"]
        mine = got.select(*[F.col(c).alias(f"_in_{c}") for c in cols])
        checked = check_answer(mine, f"_in_{raw}", shape).select(*[F.col(f"_in_{c}").alias(c) for c in cols], "problem")
    else:
        checked = got.withColumn("problem", F.lit(None).cast("string"))
    checked = cut(checked.withColumn("problem", F.coalesce("error", "problem")))  # the model is not run twice
    good, bad = checked.where(F.col("problem").isNull()), checked.where(F.col("problem").isNotNull())
    kept = good.select("question", *names, F.lit(run).alias("run"))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(store)
    every = known.unionByName(good.select("question", *names)).withColumn("error", F.lit(None).cast("string"))
    failed = bad.select("question", *[F.lit(None).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(schema).fields], F.col("problem").alias("error"))
    answered = asks.select(*key, "question").join(every.unionByName(failed), "question", "left").select(*key, *names, "error")
    return answered, bad.select("question", "problem", *names)


def annotate_active(df: DataFrame, idle: DataFrame, fn, key: list[str], schema: str) -> DataFrame:
    """Skip idle segments before the annotator is called; they come back with NULL answers."""
    busy = annotate(df.join(idle, key, "left_anti"), fn, key, schema)
    rest = df.join(idle, key, "left_semi").select(*key)
    for f in T._parse_datatype_string(schema).fields:
        rest = rest.withColumn(f.name, F.lit(None).cast(f.dataType))
    return busy.unionByName(rest.withColumn("error", F.lit(None).cast("string")))


def annotate_votes(df: DataFrame, fn, key: list[str], k: int, schema: str = "q1 int, q2 int") -> DataFrame:
    """``k`` independent votes per row; ``fn`` sees the vote number in ``vote``."""
    rows = df.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("vote"))
    return annotate(rows, fn, [*key, "vote"], schema)


def second_pass(first: DataFrame, inputs: DataFrame, violations: DataFrame, fn, key: list[str], schema: str) -> DataFrame:
    """Ask again for the violators only, with the reasons as ``feedback``; keep the first answer elsewhere."""
    fb = violations.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("feedback"))
    again = annotate(inputs.join(fb, key), fn, key, schema)
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    again = again.select(*key, *[F.col(n).alias(f"_{n}") for n in names])
    return first.join(again, key, "left").select(*key, *[F.coalesce(f"_{n}", n).alias(n) for n in names])
