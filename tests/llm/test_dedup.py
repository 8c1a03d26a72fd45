import hashlib
import random

import pytest
from helpers import empty, groups_of, kept_rows, odd_documents, rows, shingles

from clipweave.llm import exact_dedup, jaccard_join, line_dedup
from clipweave.llm.components import components


def plain_groups(docs):
    by = {}
    for i, t in docs:
        by.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append((i, t or ""))
    return by


def test_exact_groups_match_plain_form(spark):
    docs = odd_documents(spark)
    plain = plain_groups([(r.doc_id, r.text) for r in docs.collect()])
    want = []
    for members in plain.values():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        want += [(i, keep, len(members)) for i, _ in members]
    assert rows(exact_dedup.groups(docs), "doc_id", "keep_id", "group_size") == sorted(want, key=repr)
    assert exact_dedup.groups(docs).filter("kept").count() == len(plain)


def test_exact_dedup_keeps_columns_and_one_of_each(spark):
    docs = odd_documents(spark)
    out = exact_dedup.deduplicate(docs)
    assert out.schema == docs.schema
    assert out.count() == len(plain_groups([(r.doc_id, r.text) for r in docs.collect()]))
    assert (2, docs.filter("doc_id = 2").first().text) in kept_rows(out)


def test_exact_large_group(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same text', concat('t', id)) as text")
    g = exact_dedup.groups(docs)
    assert g.filter("group_size = 1000").count() == 1000
    assert [r.doc_id for r in g.filter("kept and group_size > 1").collect()] == [0]


@pytest.mark.parametrize("form", [exact_dedup.groups, exact_dedup.deduplicate, jaccard_join.join, jaccard_join.representatives, line_dedup.judged, line_dedup.deduplicate])
def test_empty_tables(spark, form):
    assert form(empty(spark)).count() == 0


def check_join(spark, docs):
    got = rows(jaccard_join.join(docs), "doc_id", "n_shingles", "component_id")
    data = [(r.doc_id, shingles(r.text)) for r in docs.select("doc_id", "text").collect()]
    pairs = []
    for i, (_, a) in enumerate(data):
        for j, (_, b) in enumerate(data[:i]):
            same = len(a & b)
            if a and b and 100 * same >= 80 * (len(a) + len(b) - same):
                pairs.append((i, j))
    group = groups_of(len(data), pairs)
    low = {}
    for (i, _), g in zip(data, group, strict=True):
        low.setdefault(g, []).append(i)
    want = []
    for (i, s), g in zip(data, group, strict=True):
        want.append((i, len(s), min((k for k in low[g] if k is not None), default=None)))
    assert got == sorted(want, key=repr)


def test_join_of_odd_documents(spark):
    check_join(spark, odd_documents(spark))


@pytest.mark.parametrize("seed", [1, 2])
def test_join_of_near_copies_matches_all_pairs(spark, seed):
    """Chains of edits around the threshold, and a passage that unrelated documents share."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    docs = []
    for k in range(6):
        base = [f"b{k}_{i}" for i in range(rng.choice([6, 20, 60]))]
        text = list(base)
        for _ in range(14):
            if rng.random() < 0.4:
                text = list(base)
            text = list(text)
            text[rng.randrange(len(text))] = rng.choice(["new", "Other", f"r{rng.random()}"])
            docs.append(" ".join(text + (passage if rng.random() < 0.3 else [])))
    docs += [" ".join([f"u{k}_{i}" for i in range(5)] + passage) for k in range(25)]
    rng.shuffle(docs)
    check_join(spark, spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))


def test_near_copies_around_one_text_are_not_compared_all_with_all(spark, monkeypatch):
    """Copies with few edits link with the text they come from; those with more must be told apart without all pairs."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(90)]
    docs = [" ".join(base)]
    for _ in range(119):
        text = list(base)
        for at in rng.sample(range(0, 90, 3), rng.choice([1, 2, 3])):
            text[at] = rng.choice(["one", "two"])
        docs.append(" ".join(text))
    met = []

    def counted(pairs, text, seed, form=jaccard_join.compared):
        met.append(pairs.count())
        return form(pairs, text, seed)

    monkeypatch.setattr(jaccard_join, "compared", counted)
    check_join(spark, spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    assert sum(met) <= 6 * len(docs)  # 522; 5,390 when further pivots were compared with all that was left


def test_representatives(spark):
    docs = odd_documents(spark)
    out = jaccard_join.representatives(docs)
    assert out.schema == docs.schema
    ids = sorted(r.doc_id for r in out.filter("doc_id is not null").collect())
    # 2 and 4 are near 1 or 3; 8 is there twice; 11 equals 10; those without words stay
    assert ids.count(8) == 1 and {1, 5, 6, 7, 10, 12, -3} <= set(ids) and not {2, 3, 11} & set(ids)
    assert out.filter("doc_id is null").count() == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (50, 49)]
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long")), "node", "root"))
    assert {got[i] for i in range(41)} == {0} and got[103] == got[101] == 100 and got[50] == 49 and len(got) == 46


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_line_links_match_all_pairs(spark, edits):
    rng = random.Random(edits)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 25))) for _ in range(12)]

    def change(s):
        s = list(s)
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(s))
            s[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        return "".join(s)

    docs = [(i, "\n".join(change(rng.choice(base)) for _ in range(rng.randint(1, 4)))) for i in range(60)] + [(None, base[0]), (90, None), (91, "")]
    got = {(r.doc_id, r.line_no): r for r in line_dedup.judged(spark.createDataFrame(docs, "doc_id long, text string"), edits, 5).collect()}
    places = {}
    for i, t in docs:
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            places.setdefault(line, []).append((i is None, i or 0, k))
    assert len(got) == len(places)
    for a, at in places.items():
        link = [b for b in places if b != a and min(len(a), len(b)) >= 5 and distance(a, b) <= edits]
        r = got[(None if min(at)[0] else min(at)[1], min(at)[2])]
        assert (r.n_rows, r.n_links, r.kept) == (len(at), len(link), all(min(at) < min(places[b]) for b in link))


def registered_lines(spark, docs, monkeypatch):
    """op7's rows over ``docs``: {(doc_id, line_no): [row]} and the set of links."""
    monkeypatch.setattr(line_dedup, "table", lambda *_: spark.createDataFrame(docs, "doc_id long, text string"))
    out = line_dedup.op7(spark, "").collect()
    at = {}
    for r in out:
        if r.kind == "line":
            at.setdefault((r.doc_id, r.line_no), []).append(r)
    links = [(r.class_id, r.other_id) for r in out if r.kind == "link"]
    assert len(links) == len(set(links))
    return at, set(links)


def test_registered_line_dedup_returns_members_and_links(spark, monkeypatch):
    line, close = "a line that three documents hold", "a line that three documents held"
    docs = [(1, line), (7, f"{line}\nown line of seven here"), (9, line), (9, line), (12, close), (None, close), (13, None)]
    at, links = registered_lines(spark, docs, monkeypatch)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert {k: len(v) for k, v in at.items()} == {(1, 0): 1, (7, 0): 1, (7, 1): 1, (9, 0): 2, (12, 0): 1, (None, 0): 1}
    assert {at[k][0].class_id for k in [(1, 0), (7, 0), (9, 0)]} == {sha(line)}
    assert links == {tuple(sorted([sha(line), sha(close)]))}
    assert [k for k, v in at.items() if v[0].kept] == [k for k in at if k in {(1, 0), (7, 1)}]
    assert {(r.n_rows, r.n_links) for r in at[(9, 0)]} == {(4, 1)} and (at[(12, 0)][0].n_rows, at[(12, 0)][0].n_links) == (2, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_registered_line_links_match_all_pairs_of_any_length(spark, monkeypatch, seed):
    rng = random.Random(seed)
    docs = [(i, "\n".join("".join(rng.choice("abcdé ") for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 12, 15, 16, 20]))) for _ in range(4))) for i in range(40)]
    docs += [(90, "Del que.\nWith to to."), (91, "Del, que.\nWith, to to."), (92, "a line of twenty signs\na line of twenty sign")]
    at, links = registered_lines(spark, docs, monkeypatch)
    lines = {line for _, t in docs for line in t.split("\n")}
    sha = {line: hashlib.sha256(line.encode()).hexdigest() for line in lines}
    assert links == {tuple(sorted((sha[a], sha[b]))) for a in lines for b in lines if a < b and distance(a, b) <= line_dedup.EDITS}
    assert {k: v[0].class_id for k, v in at.items()} == {(i, n): sha[line] for i, t in docs for n, line in enumerate(t.split("\n"))}


def test_line_dedup_text(spark):
    line, close = "a line that is long enough", "a line that is long enoughs"
    docs = spark.createDataFrame([(1, f"{line}\nfirst\n\nshort"), (2, f"{close}\nshort\n\nnew"), (3, None), (4, line)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.deduplicate(docs).collect()}
    assert got == {1: f"{line}\nfirst\n\nshort", 2: "\nnew", 3: None, 4: ""}
    odd = odd_documents(spark)
    assert line_dedup.deduplicate(odd).schema == odd.schema and line_dedup.deduplicate(odd).count() == odd.count()
