import hashlib

import numpy as np
import pytest
from helpers import empty, odd_documents, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from clipweave.llm import fill_in_middle as fim


def plain(doc_id, text):
    """By slices of the string, as the contract says."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab<PSM>é中🙂\n")), st.integers(-5, 400))
def test_one_text_matches_slices_and_comes_back(text, doc_id):
    got = fim.arrange(text.encode(), doc_id)
    n, form, low, width, out = plain(doc_id, text)
    assert got == (n, form, low, width, out.encode())
    assert fim.rebuild(got[4], form) == text.encode()


@given(st.binary(max_size=40), st.data())
def test_rotation_exchanges_blocks(data, draw):
    a, cut, b = sorted(draw.draw(st.integers(0, len(data))) for _ in range(3))
    buffer = bytearray(data)
    fim.rotate(buffer, a, cut, b)
    assert bytes(buffer) == data[:a] + data[cut:b] + data[a:cut] + data[b:]


def test_rotation_in_pieces():
    data = np.random.default_rng(0).integers(0, 256, 5 * fim.PIECE + 77, np.uint8).tobytes()
    buffer = bytearray(data)
    fim.rotate(buffer, 3, 2 * fim.PIECE + 9, len(data))
    assert bytes(buffer) == data[:3] + data[2 * fim.PIECE + 9 :] + data[3 : 2 * fim.PIECE + 9]


@pytest.mark.parametrize("extra", [[], [(20, "x<P>y"), (21, "<S>"), (22, "a<M>"), (23, "<<P"), (24, "é" * 70_000), (25, "<")]])
def test_documents(spark, extra):
    docs = odd_documents(spark).select("doc_id", "text")
    docs = docs.union(spark.createDataFrame(extra, docs.schema)) if extra else docs
    data = [(r.doc_id, r.text or "") for r in docs.collect()]
    made = fim.restore(fim.transform(docs))
    got = rows(made.selectExpr("doc_id", "n", "form", "prefix_chars", "middle_chars", "string(output) as o", "string(restored) as r"), "doc_id", "n", "form", "prefix_chars", "middle_chars", "o", "r")
    assert got == sorted(((i, *plain(i, t), t) for i, t in data), key=repr)


def test_bytes_that_are_no_text_and_extra_columns(spark):
    odd = spark.sql("select 1L as doc_id, cast(x'80ff41c3' as string) as text, 'a' as restored union all select 2L, cast(x'c3c3' as string), null")
    made = fim.restore(fim.transform(odd).selectExpr("*", "'kept' as `a.b`", "1 as restored"))
    assert {(r.doc_id, bytes(r.restored), r["a.b"]) for r in made.collect()} == {(1, b"\x80\xffA\xc3", "kept"), (2, b"\xc3\xc3", "kept")}


def test_empty(spark):
    assert fim.restore(fim.transform(empty(spark))).count() == 0
