import math
import random

import pytest
from helpers import SF, empty, odd_documents
from pyspark.sql import functions as F

from clipweave.llm import mixing, topk_search
from clipweave.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")


def plain_search(rows, k):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in sorted({i: min(v for j, v in fine if j == i) for i, _ in fine if i % 50 == 0}.items()):
        best = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in fine if j != i)[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("block,ask", [(16, 2), (4096, 512)])
def test_search_matches_plain_form(spark, block, ask):
    rng = random.Random(4)
    rows = [(i, [round(rng.uniform(-1, 1), 1) for _ in range(6)]) for i in range(0, 260, 2)]
    rows += [(1, None), (3, [0.5, None]), (5, [NAN] * 6), (7, [INF] * 6), (9, []), (50, [0.25] * 6), (11, [0.5] * 4), (13, [0.5] * 6), (15, [0.5] * 6), (100, [0.5, -0.5])]
    rows.sort()
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<float>, v string")
    got = topk_search.search(df, F.col("vec_id") % 50 == 0, per_block=block, per_ask=ask)
    assert sorted(tuple(r) for r in got.collect()) == plain_search(rows, 5)


def test_search_of_few_rows(spark):
    df = spark.createDataFrame([(50, [1.0]), (3, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk_search.search(df, F.col("vec_id") % 50 == 0).collect()] == [(50, 1, 3, 131072)]
    assert topk_search.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert QUERIES["op10_topk_search"](spark, SF).count() == 50


def test_mixing_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, "word " * rng.randint(1, 30), rng.choice(["en", "en", "en", "de"]), rng.choice(["a", "a", "b"])) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(docs, {"lang": {"en": 0.5, "de": 0.5}}, fraction=0.4).toPandas()
    total = out.tokens.sum()
    expected = (out.p * out.tokens).groupby(out.lang).sum() / total
    assert abs(expected.sum() - 0.4) < 0.01 and abs(expected["en"] - 0.2) < 0.01 and abs(expected["de"] - 0.2) < 0.01
    left = out[out.kept]
    assert abs(left.tokens.sum() / total - 0.4) < 0.03 and abs(left[left.lang == "de"].tokens.sum() / left.tokens.sum() - 0.5) < 0.05


def test_mixing_of_odd_documents(spark):
    docs = odd_documents(spark)
    out = mixing.mix(docs)
    assert out.count() == docs.count() and out.filter("p is null or p < 0 or p > 1 or weight is null").count() == 0
    assert {(r.source, r.lang) for r in out.filter("doc_id = 5").collect()} == {("(none)", "(none)")}
    kept = mixing.sample(docs)
    assert kept.schema == docs.schema and kept.count() == out.filter("kept").count()
    assert mixing.mix(empty(spark)).count() == mixing.sample(empty(spark)).count() == 0
    blank = docs.withColumn("text", F.lit(" "))
    assert mixing.mix(blank).filter("kept").count() == docs.count()


def test_registered_mixing_defaults_meet_targets_under_the_bound(spark):
    """Every value holds what its target asks, or all it has; the others of its axis keep the targets' proportions."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.kept(mixing.measured(docs))
    cells = mixing.kept(mixing.rake(rows))
    assert cells.filter("p > 1 or p < 0").count() == 0
    got = mixing.report(rows, cells).toPandas()
    for _, axis in got.groupby("axis"):
        whole = axis.most <= mixing.FRACTION
        kept_share = axis.share * mixing.FRACTION
        assert abs(axis.share.sum() - 1) < 1e-9
        ratio = kept_share / axis.target
        # a value short of its target stays whole; so do those that the redistribution fills up
        full = (kept_share - axis.natural).abs() < 5e-4
        assert full[whole].all()
        assert ((kept_share - axis.target * ratio[~full].median()).abs() < 5e-4)[~full].all()
        assert axis.met[~whole].all() or whole.any()
    assert {"prose"} < set(got[got.axis == "topic"].value) and not got[got.axis == "topic"].met.all()
    total, left = rows.groupBy().sum("tokens").first()[0], rows.join(cells, list(mixing.AXES)).selectExpr("sum(tokens * p)").first()[0]
    assert abs(left / total - mixing.FRACTION) < 1e-3


def test_bounded_mixing_keeps_other_marginals_when_one_cell_is_cut(spark):
    """A rare language that is kept whole must not shift the shares of the sources it lies in."""
    rows = [(i, "word " * 10, "xx" if i % 50 == 0 else "en", "a" if i % 50 == 0 or i % 2 else "b") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(docs, {"source": {"a": 0.5, "b": 0.5}, "lang": {"xx": 0.1, "en": 0.9}}, fraction=0.75).toPandas()
    left = (out.p * out.tokens).groupby(out.source).sum() / out.tokens.sum()
    assert abs(left["a"] - 0.375) < 1e-3 and abs(left["b"] - 0.375) < 1e-3
    assert (out.p[out.lang == "xx"] > 0.999).all()


def test_registered_mixing_with_a_hot_source_meets_what_targets_ask(spark, tmp_path):
    """A source holds a third of all tokens, and the others are nearly used up: targets bind each other."""
    rng = random.Random(9)
    forms = ["", "", "", "", "", "", "", " | ", "!! ", "### "]
    rows = [(i, "word " * rng.randint(1, 40) + rng.choice(forms), rng.choice(["en"] * 4 + ["de", "fr"]), rng.choice([f"s{k}" for k in range(12)] + ["s0"] * 4)) for i in range(6000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op5_mixing"](spark, str(tmp_path)).toPandas()
    assert ((got.p >= 0) & (got.p <= 1)).all()
    total = got.tokens.sum()
    assert abs((got.p * got.tokens).sum() / total - mixing.FRACTION) < 1e-5
    for axis in mixing.AXES:
        mass, share = got.groupby(axis).tokens.sum(), (got.p * got.tokens).groupby(got[axis]).sum()
        open_ = share < mass * 0.9999  # the others are kept whole
        ratio = (share / mass**mixing.TEMPER)[open_]
        assert ratio.max() / ratio.min() < 1 + 1e-4, axis
        whole = (mass / mass**mixing.TEMPER)[~open_]
        assert not len(whole) or whole.max() <= ratio.min() * (1 + 1e-4)


def test_mixing_says_when_targets_contradict_each_other(spark):
    """Source b is German alone: half the sample from b and a tenth German cannot both hold."""
    rows = [(i, "word " * 10, "de" if i % 2 else "en", "b" if i % 2 else "a") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    with pytest.warns(UserWarning, match="contradict"):
        out = mixing.mix(docs, {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.9, "de": 0.1}}, fraction=0.5).toPandas()
    assert len(out) == 200 and ((out.p >= 0) & (out.p <= 1)).all()
