"""Language identification by compression with per-language dictionaries (operator 9).

Every language's dictionary is raw text of a bounded sample of its labelled documents. A text is cut
into pieces, each piece is compressed with each dictionary, and the language with the smallest total
wins; ``rejected`` says that the runner-up was closer than ``margin``. Scoring is per document, over
whole texts, without a shuffle.

The fit uses at most ``per_language`` documents of each language (the smallest hashed ids) and
``piece`` bytes of each, so what reaches the driver is bounded by ``languages`` times that.

Defined cases: a null, empty or letterless text is ``und`` with score 0; rows without a language are
not learned from; equal sizes go to the language that sorts first; without any labelled row every text
is ``und``; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_text, crc_bucket, modest_batches, query, table, texts_of

LEVEL = 5
# ASCII signs and digits, which tell nothing of a language and are left out on both sides.
SIGNS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalpha())
_letter = regex.compile(r"\p{L}")


def plain(text: str) -> bytes:
    return text.lower().encode().translate(None, SIGNS)


def fit(docs: DataFrame, per_language: int = 200, piece: int = 512, languages: int = 512) -> dict[str, bytes]:
    """Raw-content dictionaries of the labelled rows of ``docs`` (doc_id, text, lang)."""
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    chosen = known.select("lang", "doc_id").withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= per_language)
    names = [r.lang for r in chosen.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()]
    # at most per_language ids of each name: a bounded list
    ids = [r.doc_id for r in chosen.filter(F.col("lang").isin(names)).select("doc_id").distinct().collect()] if names else []
    rows = known.filter(F.col("doc_id").isin(ids)).select("lang", F.xxhash64("doc_id").alias("h"), "doc_id", F.substring("text", 1, piece).alias("text")).collect() if ids else []
    text: dict[str, bytes] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.h, r.doc_id, r.text or "")):
        text[r.lang] = text.get(r.lang, b"") + plain(r.text or "") + b"\n"
    return {k: v for k, v in sorted(text.items()) if len(v) >= 8}


class Model:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)
        self.compress = []
        for data in dictionaries.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(LEVEL)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, text: str, piece: int) -> list[int]:
        data = plain(text)
        pieces = [data[i : i + piece] for i in range(0, len(data), piece)]
        return [sum(len(c(p)) for p in pieces) for c in self.compress]


@functools.lru_cache(maxsize=2)
def model(dictionaries: tuple) -> Model:
    return Model(dict(dictionaries))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], piece: int = 3072, margin: float = 0.01) -> DataFrame:
    """(doc_id, lang_pred, score, rejected): the nearest language of each whole text, a score from 0 to
    1, and whether the runner-up's size is within ``margin`` of the winner's."""
    frozen = docs.sparkSession.sparkContext.broadcast(tuple(dictionaries.items()))  # bounded by fit()

    def one(m: Model, text: str):
        if not m.names or not _letter.search(text):
            return "und", 0.0, True
        size = np.array(m.sizes(text, piece), float)
        best = int(size.argmin())
        rest = np.delete(size, best)
        return m.names[best], float(1 / np.exp(np.maximum(size[best] - size, -700)).sum()), bool(len(rest) and rest.min() - size[best] < margin * size[best])

    def work(batches):
        m = model(frozen.value)
        for batch in by_text(batches):
            lang, score, rejected = zip(*(one(m, t) for t in texts_of(batch)), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang), pa.array(score, pa.float64()), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return modest_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, lang_pred string, score double, rejected boolean")


@query("op9_language_id")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    learn = docs.filter(crc_bucket("doc_id", 4) != 2)
    out = identify(docs, fit(learn))
    return out.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
