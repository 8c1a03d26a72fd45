import base64
import hashlib
import random

import public_tokenizers as public
import pytest
import tiktoken
from helpers import SF, empty, odd_documents, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clipweave.llm import bpe, byte_bpe, token_counts
from clipweave.llm.queries import QUERIES

JSON, RANKS = public.path("byte_bpe_50k.json"), public.path("byte_bpe_multi_50k.tiktoken")
tokenizer = Tokenizer.from_file(JSON)
with open(RANKS, "rb") as f:
    encoding = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})


def library_counts(texts):
    return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab' stremvdlAE\n\t\r\u3000\x1c\x85é中1²٣!.🙂\u200b"), max_size=30), max_size=6))
def test_both_match_the_libraries(texts):
    assert [ids for ids, _ in byte_bpe.codec(RANKS).encode(texts)] == [encoding.encode_ordinary(t) for t in texts] if texts else True
    assert token_counts.counter(JSON, public.PATTERN).count(texts) == library_counts(texts)


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 900, " " * 500, "'s'll're''s ''ll\n's", "x<|endoftext|>y<|endoftext|>", "\n\n  a"])
def test_repeats_and_special_strings(text):
    assert byte_bpe.codec(RANKS).encode([text])[0][0] == encoding.encode_ordinary(text)
    assert token_counts.counter(JSON, public.PATTERN).count([text]) == library_counts([text])


def test_offsets_are_those_of_the_words():
    text = "One twö, 'tis\n 3"
    _, offset = byte_bpe.codec(RANKS).encode([text])[0]
    raw = text.encode()
    assert [raw[a:b].decode() for a, b in zip(offset, [*offset[1:], len(raw)], strict=True)] == ["One", " twö", ",", " '", "tis", "\n", " 3"]


def test_simultaneous_merges_equal_one_by_one():
    vocabulary = bpe.Vocabulary.from_ranks(RANKS)
    rng = random.Random(3)
    words = ["".join(rng.choice("abthe") for _ in range(rng.randint(0, 40))).encode() for _ in range(400)]
    ids, lengths = vocabulary.merge(words)
    at = 0
    for w, n in zip(words, lengths, strict=True):
        assert ids[at : at + n].tolist() == bpe.merge_one(vocabulary.first[list(w)].tolist(), vocabulary.pairs)
        at += n


def test_odd_documents(spark):
    docs = odd_documents(spark)
    data = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    n = library_counts([t for _, t in data])
    want = [(i, len(t.encode()), c, c > 512) for (i, t), c in zip(data, n, strict=True)]
    assert rows(token_counts.token_counts(docs, JSON, public.PATTERN), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in data:
        ids = encoding.encode_ordinary(t)
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode())))
    assert rows(byte_bpe.round_trip(docs, RANKS), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    back = byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS)
    assert sorted(((r.doc_id, bytes(r.bytes)) for r in back.collect()), key=repr) == sorted(((i, t.encode()) for i, t in data), key=repr)


def test_empty(spark):
    assert token_counts.token_counts(empty(spark), JSON, public.PATTERN).count() == byte_bpe.round_trip(empty(spark), RANKS).count() == 0


def test_queries_match_the_libraries(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in QUERIES["op3_token_counts"](spark, SF).collect()}
    assert got == dict(zip(docs, library_counts(list(docs.values())), strict=True))
    got = {r.doc_id: r.n_tokens for r in QUERIES["op4_byte_bpe"](spark, SF).collect()}
    assert got == {i: len(encoding.encode_ordinary(t)) for i, t in docs.items()}
