import zlib

import numpy as np
import pytest
from helpers import SF, empty, odd_documents

from clipweave.llm import language_id, toxicity, url_filter
from clipweave.llm.queries import QUERIES


def held_out(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def test_gradients_match_differences():
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    lex = toxicity.Lexicon([b"foo", b"ba", b"idiot", b"x"])
    ids = np.array([[0, 1, 2, -1, -1], [3, 3, 1, 0, 2], [1, -1, -1, -1, -1]])
    odds, y = np.random.default_rng(0).standard_normal(toxicity.ODDS), np.array([1, 0, 1.0])

    def loss():
        o = net.forward(net.inputs(lex, odds), ids)
        return (np.log1p(np.exp(o)) - y * o).sum()

    x = net.inputs(lex, odds)
    out, tape = net.forward(x, ids, keep=True)
    assert np.allclose(net.infer(net.given(x), ids), out, atol=1e-6)
    for name, g in net.backward(lex, x, ids, tape, toxicity.sigmoid(out) - y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        net.p[name][at] += 1e-3
        high = loss()
        net.p[name][at] -= 2e-3
        low = loss()
        net.p[name][at] += 1e-3
        assert np.isclose((high - low) / 2e-3, g[at], rtol=1e-3, atol=1e-6), name


def test_windows_cover_every_word():
    length = np.array([0, 1, 31, 32, 33, 56, 57, 500])
    owner, start = toxicity.windows(length)
    for i, n in enumerate(length):
        seen = {w for s in start[owner == i] for w in range(s, min(n, s + toxicity.WINDOW))}
        assert seen == set(range(n))


def test_toxicity_finds_a_word_anywhere(spark):
    rng = np.random.default_rng(2)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]

    def text(bad, n):
        t = list(rng.choice(words, n))
        if bad:
            t[rng.integers(n)] = "vile"
        return " ".join(t)

    y = [i % 2 for i in range(400)]
    net = toxicity.train([text(v, int(rng.integers(20, 120))) for v in y], y)
    y = [i % 2 for i in range(200)]
    long = [text(v, 2000) for v in y[:40]]
    got = net.scores([text(v, 60) for v in y] + long) >= 0.5
    assert (got == np.array(y + y[:40])).mean() > 0.95


def test_toxicity_of_odd_documents(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, 1), (4, 0), (10, 0), (None, 1), (6, None), (77, 1)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels)
    out = toxicity.score(docs, net).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in out if r.doc_id in (5, 6, 7)} == {0.0}
    clean = toxicity.clean(docs, net)
    assert clean.schema == docs.schema and clean.count() == sum(r.score < 0.5 for r in out)
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {r.score < 1e-9 for r in toxicity.score(docs, nothing).collect()} == {True}
    assert toxicity.score(empty(spark), net).count() == toxicity.clean(empty(spark), net).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op2_toxicity"](spark, sf).collect()
    assert all(r.held_out == (held_out(r.doc_id, 5) == 0) and r.predicted == (r.score >= 0.5) for r in got)
    known = [(r.score, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id in toxic]
    high, low = [s for s, y in known if y], [s for s, y in known if not y]
    assert np.mean([a > b for a in high for b in low]) > 0.8


def test_language_of_odd_documents(spark):
    docs = odd_documents(spark)
    model = language_id.fit(docs)
    out = language_id.identify(docs, model).collect()
    assert len(out) == docs.count()
    assert {r.lang_pred for r in out if r.doc_id in (5, 6, 7, 12)} == {"und"} and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out} <= {"und", "en", "de", "fr"}
    assert {r.lang_pred for r in language_id.identify(docs, {}).collect()} == {"und"}
    assert language_id.fit(empty(spark)) == {} and language_id.identify(empty(spark), model).count() == 0


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op9_language_id"](spark, sf).collect()
    assert len(got) == len(lang) and all(r.held_out == (held_out(r.doc_id, 4) == 2) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.95


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("HTTP://A.Example.ORG/es/1?q#f", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://x.com/fr/#a", "x.com", "/fr/", "com/fr/", "allow"),
        ("http://com/de/", "com", "/de/", "com/de/", "block"),
        ("http://xcom/de/", "xcom", "/de/", None, None),
        ("http://x.org", "x.org", "", None, None),
        ("//x.org/", "", "", None, None),
        ("a://b://c/d", "b:", "//c/d", None, None),
        ("http://É.Com/fr/", "É.com", "/fr/", "com/fr/", "allow"),
        ("", "", "", None, None),
        (None, "", "", None, None),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    r = url_filter.judge(spark.createDataFrame([(1, url, "x")], "page_id long, url string, host string")).first()
    assert (r.host, r.path, r.rule) == (host, path, rule)
    assert r.verdict == verdict if verdict else r.verdict == ("block" if r.score >= 0.5 else "allow")


def test_url_model(spark):
    pages = spark.createDataFrame([(1, "http://m.casino-win.example.com/en/4"), (2, "https://therst.example.net/en/9"), (2, None)], "page_id long, url string")
    got = [(r.page_id, r.verdict) for r in url_filter.judge(pages).orderBy("score").collect()]
    assert sorted(got) == [(1, "block"), (2, "allow"), (2, "allow")]
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert QUERIES["op6_url_filter"](spark, SF).count() == spark.read.parquet(f"{SF}/pages.parquet").count()
