"""Token counts by rank-synchronous array merging (operator 3).

Words are cut by the vocabulary's pattern; the distinct ones of a slice of documents are held as one
ragged numpy array, every word's lowest-rank pair is joined in the same pass, and the symbols that
survive are counted. Work is per document: no shuffle, memory bounded by a slice and a bounded cache.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; an
empty table gives an empty result; other columns are ignored. A special string inside a text is one
token, as the library has it.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary, chunks
from .common import by_text, modest_batches, query, table, texts_of

CACHE = 300_000  # words remembered by a worker


class Counter:
    def __init__(self, path: str, pattern: str):
        self.vocabulary, special = Vocabulary.from_json(path)
        self.words = regex.compile(pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cache: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        extra, split = [0] * len(texts), []
        for i, t in enumerate(texts):
            parts = self.special.split(t) if self.special else [t]
            extra[i] = len(parts) - 1
            split.append([w for p in parts for w in self.words(p)] if extra[i] else self.words(t))
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        new = [w for w in set().union(*split) if w not in cache]
        at = 0
        for run in chunks([w.encode() for w in new]):
            _, lengths = self.vocabulary.merge(run)
            cache.update(zip(new[at : at + len(run)], lengths.tolist(), strict=True))
            at += len(run)
        return [e + sum(map(cache.__getitem__, words)) for e, words in zip(extra, split, strict=True)]


@functools.lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document; ``path`` is the tokenizer file on
    every node and ``over_limit`` says that there are more than ``limit`` tokens."""

    def work(batches):
        c = counter(path, pattern)
        for batch in by_text(batches):
            n = np.array(c.count(texts_of(batch)), np.int64)
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return modest_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


@query("op3_token_counts")
def op3(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
