"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation (operator 4).

Code points become classes by one table look-up; a small automaton says where a word begins, and as
its transition functions compose associatively, blocks of text are scanned side by side: compose
inside each block, scan over the blocks, then replay with the state each block starts in. The byte
slices between boundaries are merged once each and remembered; their offsets and ids give the text back.

Defined cases: a null or empty text has no ids (the digest of the empty string); repeated rows are
encoded each; an empty table gives an empty result; other columns are ignored or, in the pipeline
form, passed through.
"""

from __future__ import annotations

import functools
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary, chunks
from .common import by_text, modest_batches, query, table, texts_of

CACHE = 100_000  # slices remembered by a worker
BLOCK = 64
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE_LAST, WHITE_LAST, WHITE, END = range(9)
FRESH, IN_LETTER, IN_NUMBER, IN_OTHER, IN_WHITE, AFTER_SPACE, SKIP1, SKIP2 = range(8)


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point (letters, numbers, white space, the rest); END closes a text."""
    out = np.full(0x110001, OTHER, np.uint8)
    every = "".join(map(chr, (i for i in range(0x110000) if not 0xD800 <= i < 0xE000)))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\p{White_Space}")):
        out[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
    out[0x110000] = END
    return out


@functools.lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """next state and "a word begins here", both indexed by state * 9 + symbol."""
    step, begin = np.zeros((8, 9), np.uint8), np.ones((8, 9), bool)
    for state in range(8):
        for symbol, run in ((LETTER, IN_LETTER), (NUMBER, IN_NUMBER), (OTHER, IN_OTHER)):
            step[state, symbol] = run
            begin[state, symbol] = state not in (run, AFTER_SPACE)
        for symbol, skip in ((SHORT, SKIP1), (LONG, SKIP2)):  # an apostrophe that a known ending follows
            inside = state in (IN_OTHER, AFTER_SPACE)
            step[state, symbol] = IN_OTHER if inside else skip
            begin[state, symbol] = not inside
        step[state, SPACE_LAST] = AFTER_SPACE  # the last blank goes to the next word
        step[state, WHITE_LAST] = FRESH
        step[state, WHITE] = IN_WHITE
        begin[state, WHITE] = state != IN_WHITE
        step[state, END] = FRESH
    step[SKIP1, LETTER], begin[SKIP1, LETTER] = FRESH, False
    step[SKIP2, LETTER], begin[SKIP2, LETTER] = SKIP1, False
    return step.ravel(), begin.ravel()


def symbols(points: np.ndarray) -> np.ndarray:
    """Automaton symbols of code points in which 0x110000 closes each text."""
    sym = classes()[points]
    after = np.concatenate([sym[1:], [END]])
    last = (sym == WHITE) & (after != WHITE) & (after != END)
    p1 = np.concatenate([points[1:], [0x110000]])
    p2 = np.concatenate([points[2:], [0x110000] * 2])[: len(points)]
    quote = points == ord("'")
    if quote.any():
        one = np.isin(p1, [ord(c) for c in "stmd"])
        two = np.zeros(len(points), bool)
        for a, b in ("re", "ve", "ll"):
            two |= (p1 == ord(a)) & (p2 == ord(b))
        sym[quote & one] = SHORT
        sym[quote & two] = LONG
    sym[last] = WHITE_LAST
    sym[last & (points == 0x20)] = SPACE_LAST
    return sym


def begins(sym: np.ndarray) -> np.ndarray:
    """Positions at which a word begins, by a scan over transition functions."""
    step, begin = automaton()
    n = len(sym)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, END, np.uint8)
    grid[:n] = sym
    grid = grid.reshape(rows, BLOCK)
    moves = np.ascontiguousarray(step.reshape(8, 9).T)  # symbol -> function of states
    f = moves[grid[:, 0]]
    base = (np.arange(rows, dtype=np.int32) * 8)[:, None]
    for j in range(1, BLOCK):
        g = moves[grid[:, j]]
        f = g.ravel().take(f + base)  # f, then this symbol
    reach = 1
    while reach < rows:  # inclusive scan over the blocks' functions
        late = f[reach:]
        f = np.concatenate([f[:reach], late.ravel().take(f[:-reach] + base[: len(late)])])
        reach *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = f[:-1, FRESH]
    hit = np.empty((rows, BLOCK), bool)
    for j in range(BLOCK):
        at = state.astype(np.intp) * 9 + grid[:, j]
        hit[:, j] = begin[at]
        state = step[at]
    return np.flatnonzero(hit.ravel()[:n])


def slices(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Byte slices of all words, how many each text has, and their byte offsets in its UTF-8."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = "".join(texts)
    raw = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(lengths)
    points = np.insert(raw, ends, 0x110000)
    ends = ends + np.arange(len(texts))  # where the closing marks are
    at = begins(symbols(points))
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    width[ends] = 0
    byte = np.concatenate([[0], np.cumsum(width)])
    start = byte[at]
    mark = np.zeros(len(points), bool)
    mark[ends] = True
    word = ~mark[at]
    stop = np.append(start[1:], byte[-1])[word]
    start = start[word]
    blob = joined.encode()
    owner = np.searchsorted(ends, at[word])
    count = np.bincount(owner, minlength=len(texts))
    first = byte[ends - lengths]
    return [blob[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)], count, start - first[owner]


class Codec:
    def __init__(self, path: str):
        self.vocabulary = Vocabulary.from_ranks(path)
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.written = [str(i) for i in range(len(self.vocabulary.names))]

    def learn(self, words: list[bytes]) -> None:
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = [w for w in set(words) if w not in self.cache]
        for run in chunks(new):
            ids, lengths = self.vocabulary.merge(run)
            ids, stop = ids.tolist(), np.cumsum(lengths).tolist()
            self.cache.update((w, tuple(ids[a:b])) for w, a, b in zip(run, [0, *stop], stop, strict=False))

    def encode(self, texts: list[str]) -> list[tuple[list[int], np.ndarray]]:
        """Per text its ids and the byte offset of each word."""
        words, count, offset = slices(texts)
        self.learn(words)
        out, at = [], 0
        for n in count.tolist():
            out.append((list(chain.from_iterable(map(self.cache.__getitem__, words[at : at + n]))), offset[at : at + n]))
            at += n
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.names.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every document, ids as an array."""

    def work(batches):
        c = codec(path)
        for batch in by_text(batches):
            ids = [x for x, _ in c.encode(texts_of(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return modest_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes) of every row of ``encode``."""

    def work(batches):
        c = codec(path)
        for batch in batches:
            ids = batch.column("ids")
            flat, at = ids.flatten().to_pylist(), np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)))
            data = [c.decode(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of encoding and decoding every document in one pass: (doc_id, n_tokens, ids_sha256,
    decoded_sha256, same), where ``same`` says that decoding gave the text back."""

    def digest(c: Codec, text: str, ids: list[int]):
        back = c.decode(ids)
        sha = hashlib.sha256(",".join(map(c.written.__getitem__, ids)).encode()).hexdigest()
        return len(ids), sha, hashlib.sha256(back).hexdigest(), back == text.encode()

    def work(batches):
        c = codec(path)
        for batch in by_text(batches):
            texts = texts_of(batch)
            rows = [digest(c, t, ids) for t, (ids, _) in zip(texts, c.encode(texts), strict=True)]
            n, a, b, same = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(same)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same"])

    return modest_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")


@query("op4_byte_bpe")
def op4(spark, sf_dir):
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
