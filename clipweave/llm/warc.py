"""WARC archives with revisit resolution (operator 12).

``write`` hashes every payload where it lies and shuffles headers only: (digest, size) groups agree on their
largest page_id, headers are joined to that choice, and what follows needs no payload but that of responses.
Revisit records are written from headers alone; responses are the pages that are not in the list of revisits (an
anti-join, for which Spark moves payloads only where that list is too large for it to broadcast). Every record
gets fresh headers whose ids are derived from its content, so a task that runs again writes the same bytes.

Archives are gzip files of plain WARC/1.1 records, written by Spark's text writer with the record terminator as
line separator, so they go through whatever file system Spark has, with its commit protocol. ``read`` takes each
file as one stream (gzip files are not split) and cuts records by Content-Length, whatever payloads hold; a
digest that does not fit its payload fails the job. ``resolve`` joins revisits to the responses they name.

Defined cases: a null html is an empty payload; a null url is written as ``urn:page:`` and the id; control characters
and blanks of a url are escaped in the header only; a null page_id ranks below all others and has no id in its
header; rows that repeat the largest page_id of a group are all responses; equal payloads under ``LEAST`` bytes are
all responses; an empty table gives empty archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, modest_batches, query, shared_dir, table

LEAST = 1000  # bytes from which equal payloads are written once
RECORDS = 50_000  # a file's records at most
DATE = "1970-01-01T00:00:00Z"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_id string, record_type string, refers_to_id string, payload_digest string, payload_bytes long"


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest) of every page, without its payload."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string").alias("url"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha1(html).alias("payload_digest"),
    )


def revisits(heads: DataFrame, least: int = LEAST) -> DataFrame:
    """``heads`` of the pages whose payload another page's response holds, with that page's id as ``original``."""
    large = heads.filter(F.col("payload_bytes") >= least)
    # per digest one number, combined before the shuffle
    chosen = large.groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count("*").alias("rows"))
    # kept: where one digest has a large part of the rows, Spark can split a join of two scans, not one of an aggregate
    chosen = kept(chosen.filter("rows > 1 and original is not null").select("payload_digest", "original"))
    return large.join(chosen, "payload_digest").filter(~F.col("page_id").eqNullSafe(F.col("original")))


def record_id(page_id: str, digest: str) -> Column:
    """The id of a page's record, from its page_id and digest."""
    h = F.md5(F.concat_ws(":", F.coalesce(F.col(page_id).cast("string"), F.lit("-")), F.col(digest)).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def escaped(text: Column) -> Column:
    for c in "%\r\n\t ":
        text = F.replace(text, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return text


def unescaped(text: str) -> str:
    for c in " \t\n\r%":
        text = text.replace(f"%{ord(c):02X}", c)
    return text


def lines(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def record(kind: str, date: str) -> Column:
    """A record of ``kind`` without its terminator; responses end in the column ``html``."""
    http = lines("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", F.col("payload_bytes").cast("string"), END)
    length = F.octet_length(http) + (F.col("payload_bytes") if kind == "response" else F.lit(0))
    shown = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    head = lines(
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: ",
        record_id("page_id", "payload_digest"),
        f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: ",
        F.coalesce(escaped(F.col("url")), F.concat(F.lit("urn:page:"), shown)),
        F.when(F.col("url").isNull(), F.lit("\r\nX-No-URI: 1")).otherwise(""),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("\r\nX-Page-ID: "), shown)).otherwise(""),
        "\r\nWARC-Payload-Digest: sha1:",
        F.col("payload_digest"),
    )
    if kind == "revisit":
        head = lines(head, f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: ", record_id("original", "payload_digest"))
    block = F.concat(http, F.coalesce(F.col("html").cast("string"), F.lit(""))) if kind == "response" else http
    return lines(head, "\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: ", length.cast("string"), END, block)


def write(pages: DataFrame, path: str, least: int = LEAST, date: str = DATE) -> None:
    """Archives of ``pages`` (page_id, url, html) under ``path``: folders ``responses`` and ``revisits``."""
    spark = pages.sparkSession
    again = revisits(kept(headers(pages)), least)
    found = f"{path}/revisit-headers"
    again.write.parquet(found)  # without payloads; its size lets Spark choose the anti-join's form
    again = spark.read.schema(again.schema).parquet(found)
    save(again.select(record("revisit", date).alias("value")), f"{path}/revisits")
    full = pages.select(F.col("html").cast("string").alias("html"), F.col("page_id").cast("long"), F.col("url").cast("string"))
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    full = full.select("*", F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("payload_digest"))
    gone = again.select(F.col("page_id").alias("gone_id"), F.col("payload_digest").alias("gone_digest"))
    own = full.join(gone, F.col("page_id").eqNullSafe(F.col("gone_id")) & (F.col("payload_digest") == F.col("gone_digest")), "left_anti")
    save(own.select(record("response", date).alias("value")), f"{path}/responses")


def save(records: DataFrame, path: str) -> None:
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def parse(head: bytes) -> dict[str, str]:
    first, *rest = head.decode("utf-8", "surrogateescape").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record begins with {first[:40]!r}")
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in rest)}


def records(chunks):
    """(headers, block) of each record in a stream of byte strings; holds one record and one chunk."""
    held = bytearray()
    fields, size, at = None, 0, 0
    for chunk in chunks:
        held += chunk
        while True:
            if fields is None:
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                fields, at = parse(bytes(held[at:end])), end + 4
                size = int(fields["content-length"])
            if len(held) < at + size + 4:
                break
            yield fields, bytes(held[at : at + size])
            if held[at + size : at + size + 4] != b"\r\n\r\n":
                raise ValueError(f"record {fields.get('warc-record-id')} does not end where it says")
            fields, at = None, at + size + 4
        if at:
            del held[:at]
            at = 0
    if fields is not None or held:
        raise ValueError("an archive ends inside a record")


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Rows of all records under ``path`` (``RECORD``, with ``payload`` as bytes if asked); of revisits, the
    payload and its size are null. Each archive is read from its first byte to its last in one task."""

    def row(fields: dict[str, str], block: bytes):
        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
        body = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
        if body is not None and hashlib.sha1(body).hexdigest() != digest:
            raise ValueError(f"record {fields['warc-record-id']} does not hold the payload of its digest")
        page = fields.get("x-page-id")
        url = None if "x-no-uri" in fields else unescaped(fields["warc-target-uri"])
        return None if page is None else int(page), url, fields["warc-record-id"], kind, fields.get("warc-refers-to"), digest, None if body is None else len(body), body

    def work(batches):
        def stream():
            for batch in batches:
                if batch.num_rows:
                    yield b"\n".join([*batch.column(0).to_pylist(), b""])

        out, held = [], 0
        for fields, block in records(stream()):
            out.append(row(fields, block))
            held += len(block)
            if len(out) >= 1000 or payload and held > 4_000_000:
                yield table_of(out)
                out, held = [], 0
        if out:
            yield table_of(out)

    def table_of(rows):
        page, url, own, kind, other, digest, size, body = zip(*rows, strict=True)
        columns = [pa.array(page, pa.int64()), pa.array(url, pa.string()), pa.array(own), pa.array(kind), pa.array(other, pa.string()), pa.array(digest), pa.array(size, pa.int64())]
        names = ["page_id", "url", "record_id", "record_type", "refers_to_id", "payload_digest", "payload_bytes"]
        if payload:
            columns, names = [*columns, pa.array(body, pa.binary())], [*names, "payload"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    text = spark.read.schema("value string").option("lineSep", "\n").text([f"{path}/responses", f"{path}/revisits"])
    return modest_batches(text).select(F.col("value").cast("binary")).mapInArrow(work, RECORD + (", payload binary" if payload else ""))


def resolve(read_back: DataFrame) -> DataFrame:
    """``read_back`` with ``refers_to`` (page_id) and, for revisits, size (and payload) of the response they name."""
    full = [c for c in ("payload_bytes", "payload") if c in read_back.columns]
    named = read_back.filter("record_type = 'revisit'").select(F.col("refers_to_id").alias("to_id")).distinct()
    answers = read_back.filter("record_type = 'response'").select(F.col("record_id").alias("to_id"), F.col("page_id").alias("refers_to"), *(F.col(c).alias(f"to_{c}") for c in full))
    # rows that repeat an id and payload share a record id; one answers for them
    answers = kept(answers.join(named, "to_id").dropDuplicates(["to_id"]))
    joined = read_back.join(answers, F.col("refers_to_id") == F.col("to_id"), "left")
    rest = [c for c in read_back.columns if c not in full]
    return joined.select(*rest, "refers_to", *(F.coalesce(c, f"to_{c}").alias(c) for c in full))


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), o AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM p
), r AS (
  SELECT *, payload_bytes >= 1000 AND original IS NOT NULL AND page_id IS DISTINCT FROM original AS again FROM o
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN original END AS refers_to
FROM r
"""


@query("op12_warc", SQL)
def op12(spark, sf_dir):
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), path)
    return resolve(kept(read(spark, path))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
