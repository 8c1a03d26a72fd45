import random
from collections import Counter

import numpy as np
import pytest
from helpers import empty, odd_documents

from clipweave.llm import collocations as col

UP = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ENDS = str.maketrans({c: "\n" for c in ".,;:!?\x0b\x0c\r"})


def pieces(text):
    return [[w for w in p.replace("\t", " ").split(" ") if w] for p in (text or "").translate(UP).translate(ENDS).split("\n")]


def plain(docs, least=10, top=2000, inside=50):
    """By counting every phrase of one to three words."""
    f, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            n[lang] += len(p)
            for k in (1, 2, 3):
                f.setdefault(lang, Counter()).update(tuple(p[i : i + k]) for i in range(len(p) - k + 1))
    out = set()
    for lang, count in f.items():
        found = []
        for v, a in count.items():
            if len(v) < 2 or a < least:
                continue
            longer = [w for w, b in count.items() if len(w) == 3 > len(v) and b >= least and 100 * b >= inside * a and v in (w[:2], w[1:])]
            if longer:
                continue
            cuts = [(1_000_000 * a * a // (count[v[:k]] * count[v[k:]]), k) for k in range(1, len(v))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(v).encode(), count[v[:k]], count[v[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def check(spark, docs, **kw):
    data = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    got = [tuple(r) for r in col.collocations(docs, **kw).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(data, **kw)
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts_match_plain_counts(spark, seed):
    """Few words, repeated passages (chains of unary nodes), loops of one word, pieces of one and two words."""
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(40))
    docs = []
    for i in range(120):
        words = [rng.choice(["a", "B", "c", "dd", "Ée", "x\x1cy"]) + rng.choice(["", "", "1"]) for _ in range(rng.randint(0, 30))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for w in words)
        text += rng.choice(["", "", passage + ". ", "p5 p6 p7 p9, ", "la la la la la la ", "\x0b", "one.", "two words!"])
        docs.append((rng.choice(["en", "de", None, "und"]), text))
    df = spark.createDataFrame(docs, "lang string, text string")
    got = check(spark, df, least=5)
    assert any(r[2] == "p10 p11 p12" for r in got)
    check(spark, df, least=5, top=3)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    assert check(spark, docs.union(docs).union(docs), least=3)


def test_empty(spark):
    assert col.collocations(empty(spark)).count() == 0
    assert col.collocations(spark.createDataFrame([(None, None), ("en", ""), ("en", " .,")], "lang string, text string")).count() == 0


def test_paths_are_compact(spark):
    chain = " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame([("en", chain)] * 12 + [("en", "w3 w4")] * 4 + [("en", "w20 w21 w22 other")] * 11, "lang string, text string")
    full = col.graph(docs)
    nodes = col.pairs(full)
    got = {(tuple(r.words), r.n, r.flow, r.to_flow) for r in col.compact(col.frequent(full, nodes)).collect()}
    w = [f"w{i}" for i in range(70)]
    # cut where a pair also occurs elsewhere
    assert got == {(tuple(w[:5]), 12, 12, 16), (tuple(w[3:22]), 12, 16, 23), (tuple(w[20:23]), 23, 23, 23), (tuple(w[21:]), 12, 23, 12), (("w21", "w22", "other"), 11, 23, 11)}


def test_many_different_words_do_not_overflow():
    rng = np.random.default_rng(0)
    text = " ".join(map(str, rng.integers(0, 1 << 40, 30_000).tolist() * 2)).encode()
    few = {(r["node"], r["next"]): r["n"] for r in col.triples([text]).to_pylist()}
    many = col.triples([text, " ".join(f"x{i}" for i in range(1 << 21)).encode()])  # more words than 21 bits number
    count = dict(zip(zip(many.column("node").to_pylist(), many.column("next").to_pylist(), strict=True), many.column("n").to_pylist(), strict=True))
    assert len(count) == len(few) + (1 << 21) and all(count[k] == n for k, n in few.items())


def test_products_beyond_64_bits(spark):
    found = spark.createDataFrame([("en", "a b c", "a", "c", 4 * 10**12, 5 * 10**12, 4 * 10**12 + 1)], "lang string, phrase string, first string, last string, a long, l2 long, r1 long")
    vocabulary = spark.createDataFrame([("en", "a", 9 * 10**12), ("en", "c", 7 * 10**12)], "lang string, word string, count long")
    r = col.scored(found, vocabulary).first()
    a = 4 * 10**12
    s1, s2 = 10**6 * a * a // (9 * 10**12 * (a + 1)), 10**6 * a * a // (5 * 10**12 * 7 * 10**12)
    assert (r.score, r.l, r.r) == min((s1, 9 * 10**12, a + 1), (s2, 5 * 10**12, 7 * 10**12))
