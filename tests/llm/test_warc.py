import gzip
import hashlib
import tempfile

import pytest
from helpers import rows

from clipweave.llm import warc

PAGES = "page_id long, url string, html string, record_type string, `a.b` int"
BIG = "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "é" * 700


def pages(spark):
    """Nulls, payloads that look like records or end in terminators, groups of equal ones, very long ones."""
    data = [
        (1, "http://a/1", BIG),
        (2, "http://a/ 2\r\nX: y", BIG),
        (7, None, BIG),
        (None, "http://n", BIG),
        (3, "http://a/3%0D", "short"),
        (4, None, "short"),
        (5, "", None),
        (6, "http://é", ""),
        (8, "http://a/8", BIG + "\r\n"),
        (9, "http://a/9", BIG + "\r\n\r\n"),
        (10, "http://a/10", "\n" * 1500),
        (11, "http://a/11", "\r\n\r" * 400),
        (12, "http://a/12", "long line " * 300_000),
        (13, "http://a/13", "long line " * 300_000),
        (20, "http://a/20", "twice" * 300),
        (20, "http://a/20", "twice" * 300),
        (19, "http://a/19", "twice" * 300),
        (None, "x", "nobody" * 300),
        (None, "x", "nobody" * 300),
        (-4, "http://a/-4", "\r" * 999),
        (-5, "http://a/-5", "\r" * 999),
        (30, "http://a/30", "\r" * 1000),
        (31, "http://a/31", "\r" * 1000),
    ]
    return spark.createDataFrame([(*r, "x", 1) for r in data], PAGES)


def plain(data):
    """(page_id, url, type, refers_to, payload) by the definition."""
    out = []
    for i, url, html in data:
        body = (html or "").encode()
        best = max((j for j, _, h in data if (h or "").encode() == body and j is not None), default=None)
        again = len(body) >= warc.LEAST and best is not None and i != best
        out.append((i, url, "revisit" if again else "response", best if again else None, body))
    return out


def test_archives_read_back(spark):
    docs = pages(spark)
    data = [(r.page_id, r.url, r.html) for r in docs.collect()]
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/w"
    warc.write(docs, path)
    got = warc.resolve(warc.read(spark, path, payload=True))
    want = plain(data)
    assert sorted(((r.page_id, r.url, r.record_type, r.refers_to, bytes(r.payload)) for r in got.collect()), key=repr) == sorted(want, key=repr)
    slim = warc.resolve(warc.read(spark, path))
    assert rows(slim, "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest") == sorted(((i, k, o, len(b), hashlib.sha1(b).hexdigest()) for i, _, k, o, b in want), key=repr)


def test_files_are_plain_warc(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/w"
    warc.write(pages(spark).repartition(3), path)
    names = [f for f in spark.read.format("binaryFile").load([f"{path}/responses", f"{path}/revisits"]).select("path", "content").collect() if f.content]
    assert names
    seen = []
    for f in names:
        data = gzip.decompress(bytes(f.content))
        got = list(warc.records(data[i : i + 4096] for i in range(0, len(data), 4096)))
        seen += [h["warc-record-id"] for h, _ in got]
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n")
    assert len(seen) == 23


@pytest.mark.parametrize("cut", [1, 2, 3, 5, 8, 1000])
def test_stream_cut_anywhere(cut):
    blocks = [b"", b"\r\n\r\n", b"a\r\n", b"WARC/1.1\r\n\r\n", b"x" * 50]
    data = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(b), b) for b in blocks)
    assert [b for _, b in warc.records(data[i : i + cut] for i in range(0, len(data), cut))] == blocks


def test_damage_is_noticed():
    good = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    for bad in (good[:-5], good + b"x", good.replace(b": 2", b": 1"), b"HTTP/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.records([bad]))


def test_empty(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/w"
    warc.write(spark.createDataFrame([], PAGES), path)
    assert warc.resolve(warc.read(spark, path)).count() == 0


def test_large_group(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/w"
    warc.write(spark.range(3000).selectExpr("id as page_id", "'u' as url", "if(id % 3 = 0, repeat('same ', 300), concat(id, repeat('-', 1000))) as html"), path)
    got = warc.resolve(warc.read(spark, path))
    assert got.filter("record_type = 'revisit' and refers_to = 2997").count() == 999 and got.count() == 3000
