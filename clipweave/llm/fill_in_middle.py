"""Fill-in-middle transformation by in-place block rotation (operator 13).

The bytes of a text go into one bytearray together with its three sentinels, in the order prefix, middle,
suffix. Two neighbouring blocks then change places by three reversals inside that buffer (each reversal swaps
pieces of at most ``PIECE`` bytes, so nothing but the buffer grows with the text): the middle and suffix blocks
for ``psm``, everything before the suffix and the suffix for ``spm``. ``restore`` knows only output and form: it
finds the sentinels, rotates the blocks back and takes the sentinels out. Cuts are drawn from a hash of the id,
so a task that runs again gives the same rows; work is per row, without any shuffle.

Defined cases: a null or empty text is ``plain`` with an empty output; a text that holds a sentinel is ``plain``;
a null id is hashed as the empty string; rows that repeat an id and text give equal rows; code points are bytes
that do not continue one, so strings that are not valid UTF-8 pass through unharmed; an empty table gives an empty
result; other columns are ignored by ``transform`` and pass through ``restore``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import by_text, modest_batches, named, query, table

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM = 90  # of 100 hash values, those from here on stay plain
SPM_BELOW = 20  # of 100 hash values of the others, those below become spm
PIECE = 1 << 16
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def draws(doc_id: int | None) -> list[int]:
    """The four numbers that decide on a document."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def turn(view: np.ndarray, a: int, b: int) -> None:
    """Reverse view[a:b] in place."""
    while b - a > 1:
        n = min(PIECE, (b - a) // 2)
        head = view[a : a + n].copy()
        view[a : a + n] = view[b - n : b][::-1]
        view[b - n : b] = head[::-1]
        a, b = a + n, b - n


def rotate(buffer: bytearray, a: int, cut: int, b: int) -> None:
    """Exchange the blocks buffer[a:cut] and buffer[cut:b] in place."""
    view = np.frombuffer(buffer, np.uint8)
    turn(view, a, cut)
    turn(view, cut, b)
    turn(view, a, b)


def offsets(text: bytes, *points: int) -> tuple[int, list[int]]:
    """How many code points ``text`` has, and the bytes at which those numbered ``points`` begin."""
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return len(starts), [int(starts[p]) if p < len(starts) else len(text) for p in points]


def count(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def arrange(text: bytes, doc_id: int | None) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    n = count(text)
    one, two, keep, side = draws(doc_id)
    if not text or keep % 100 >= PLAIN_FROM or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((one % (n + 1), two % (n + 1)))
    _, (p, q) = offsets(text, low, high)
    buffer = bytearray(text)
    buffer[q:q] = SUFFIX
    buffer[p:p] = MIDDLE
    buffer[0:0] = PREFIX
    middle, suffix = p + len(PREFIX), q + len(PREFIX) + len(MIDDLE)
    if side % 100 < SPM_BELOW:
        rotate(buffer, 0, suffix, len(buffer))
        return n, "spm", low, high - low, bytes(buffer)
    rotate(buffer, middle, suffix, len(buffer))
    return n, "psm", low, high - low, bytes(buffer)


def rebuild(output: bytes, form: str) -> bytes:
    """The text from which ``output`` was made."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    prefix, suffix = output.index(PREFIX), output.index(SUFFIX)
    if form == "spm":
        rotate(buffer, 0, prefix, len(buffer))
    else:
        rotate(buffer, suffix, output.index(MIDDLE), len(buffer))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.index(mark)
        del buffer[at : at + len(mark)]
    return bytes(buffer)


def transform(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document; ``output`` as UTF-8 bytes."""

    def work(batches):
        for batch in by_text(batches):
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            rows = [arrange(t or b"", i) for t, i in zip(texts, ids.to_pylist(), strict=True)]
            n, form, low, width, out = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(form), pa.array(low, pa.int64()), pa.array(width, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return modest_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(work, OUT)


def restore(made: DataFrame) -> DataFrame:
    """``made`` (from ``transform``, or any rows with ``output`` and ``form``) with ``restored``, the text as bytes."""
    rest = made.drop("restored").drop("output", "form")
    plain = made.select("output", "form", *named(rest)).toDF("output", "form", *(f"c{i}" for i in range(len(rest.columns))))
    names = plain.columns

    def work(batches):
        for batch in batches:
            texts = [rebuild(o or b"", f) for o, f in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.binary())], names=[*names, "restored"])

    back = plain.mapInArrow(work, StructType(list(plain.schema.fields)).add("restored", "binary")).toDF("output", "form", *rest.columns, "restored")
    return back.select(*named(made.drop("restored")), "restored")


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), d AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), x AS (
  SELECT *, substr(t, 1, p) AS pre, substr(t, p + 1, q - p) AS mid, substr(t, q + 1) AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM x
"""


@query("op13_fill_in_middle", SQL)
def op13(spark, sf_dir):
    made = restore(transform(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
