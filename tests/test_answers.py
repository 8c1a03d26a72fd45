"""The annotator: who is asked how often, what is kept, what is rejected."""

import os
import tempfile

import pandas as pd
import pytest

from clipweave.operators.answers import RowsFailed, annotate, ask_once, stored_answers
from clipweave.schemas import Answer


def calls(folder):
    """Rows asked so far, as noted by the annotator."""
    out = []
    for f in os.listdir(folder):
        with open(f"{folder}/{f}") as file:
            out += [int(x) for x in file.read().split()]
    return sorted(out)


@pytest.fixture()
def note():
    def note(folder, batch):
        fd, _ = tempfile.mkstemp(dir=folder)
        with os.fdopen(fd, "w") as f:
            f.write(" ".join(map(str, batch["x"])))

    return note


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_rows_named_by_the_annotator_are_asked_once_more(spark, folder, note):
    def fn(batch):
        note(folder, batch)
        bad = {i: f"no {x}" for i, x in enumerate(batch["x"]) if x % 10 == 3}
        if bad:
            raise RowsFailed(bad, pd.DataFrame({"y": batch["x"] * 2}))
        return pd.DataFrame({"y": batch["x"] * 2})

    got = {r.x: (r.y, r.error) for r in annotate(spark.range(40).toDF("x").coalesce(1), fn, ["x"], "y long").collect()}
    assert got == {x: (None, f"no {x}") if x % 10 == 3 else (2 * x, None) for x in range(40)}
    assert calls(folder) == sorted([*range(40), 3, 13, 23, 33])


def test_an_error_column_costs_no_second_call(spark, folder, note):
    def fn(batch):
        note(folder, batch)
        return pd.DataFrame({"y": batch["x"], "error": [f"odd {x}" if x % 2 else None for x in batch["x"]]})

    got = {r.x: (r.y, r.error) for r in annotate(spark.range(10).toDF("x").coalesce(1), fn, ["x"], "y long").collect()}
    assert got == {x: (None, f"odd {x}") if x % 2 else (x, None) for x in range(10)} and calls(folder) == list(range(10))


def test_after_any_other_failure_each_row_is_asked_at_most_twice(spark, folder, note):
    def fn(batch):
        note(folder, batch)
        if (batch["x"] == 17).any():
            raise ValueError("seventeen")
        return pd.DataFrame({"y": batch["x"].astype(str)})

    got = {r.x: (r.y, r.error) for r in annotate(spark.range(64).toDF("x").coalesce(1), fn, ["x"], "y string").collect()}
    assert got == {x: (None, "ValueError: seventeen") if x == 17 else (str(x), None) for x in range(64)}
    assert calls(folder) == sorted([*range(64)] * 2)


def test_known_answers_are_not_asked_again(spark, folder, note):
    store = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/store"
    shape = Answer("v int", ("v",))

    def fn(batch):
        note(folder, batch)
        return pd.DataFrame({"answer": ["{" if x == 4 else f'{{"v": {x}}}' for x in batch["x"]], "error": ["down" if x == 5 else None for x in batch["x"]]})

    rows = spark.createDataFrame([(i, i % 6) for i in range(30)], "id long, x long")

    def ask(df, run, version="1"):
        got, bad = ask_once(df, fn, ["id"], ["x"], "answer string", store, run, version, shape)
        return {r.id: (r.answer, r.error) for r in got.collect()}, {r.problem for r in bad.collect()}

    got, bad = ask(rows, "one")
    good = lambda x: (f'{{"v": {x}}}', None)
    assert {k: v for k, v in got.items() if k % 6 < 4} == {i: good(i % 6) for i in range(30) if i % 6 < 4}
    assert got[4] == (None, "not a JSON object") and got[5] == (None, "down") and bad == {"not a JSON object", "down"}
    assert calls(folder) == [0, 1, 2, 3, 4, 5]  # each question once
    fewer = rows.where("x < 4")
    again, bad = ask(fewer, "two")
    assert again == {i: good(i % 6) for i in range(30) if i % 6 < 4} and not bad and calls(folder) == [0, 1, 2, 3, 4, 5]
    ask(rows, "three")  # only what failed
    assert calls(folder) == [0, 1, 2, 3, 4, 4, 5, 5]
    ask(fewer, "four", "2")  # another version of the annotator
    assert calls(folder) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert stored_answers(spark, store, "answer string").count() == 8


def test_a_repeated_run_replaces_its_answers(spark, folder, note):
    store = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/store"

    def fn(batch):
        return pd.DataFrame({"y": batch["x"]})

    for _ in range(2):
        ask_once(spark.range(5).toDF("x"), fn, ["x"], ["x"], "y long", store, "same")
    assert stored_answers(spark, store, "y long").count() == 5


def test_the_stand_in_names_its_failing_rows():
    """So a failing row costs one more call, and not one for every row of its batch."""
    from clipweave.catalog.io_queries import name_it

    labels = ["a", "put down the purchase", "bc"]
    with pytest.raises(RowsFailed) as e:
        name_it(pd.DataFrame({"left_label": labels}))
    assert e.value.errors == {1: "ValueError: nothing to name"} and list(e.value.answers["n"])[::2] == [1, 2]
    assert list(name_it(pd.DataFrame({"left_label": labels[::2]}))["answer"]) == ["A", "BC"]
