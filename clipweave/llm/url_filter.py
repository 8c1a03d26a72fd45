"""URL filter: rules first, then logistic regression on hashed character n-grams (operator 6).

Host, path and the longest fitting rule are Spark expressions. Where no rule fits, the verdict is the
model's: n-grams of host and path are hashed into a fixed number of weights, learned by gradient
descent from a small table of labelled URLs that the caller may replace. Per row, no shuffle.

Defined cases: a null URL or one without ``://`` has an empty host and path and no rule, and is judged
by the bias alone; repeated rows are judged each; an empty table gives an empty result; other columns
are ignored. Rules of equal length: the one listed first.
"""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import query, table

GRAMS = (3, 4, 5)
BITS = 15

# Labelled URLs to learn from when the caller gives none (1: block).
LABELLED = [
    ("http://casino-win.example.com/en/12", 1),
    ("https://www.casino-bonus.example.net/play", 1),
    ("http://best-casino.example.org/slots/7", 1),
    ("https://free-bets.example.com/en/88", 1),
    ("http://m.free-spins.example.net/de/3", 1),
    ("https://online-bets.example.org/win", 1),
    ("http://cheap-pills.example.com/de/41", 1),
    ("https://buy-pills.example.net/order.html", 1),
    ("http://blog.cheap-meds.example.org/fr/9", 1),
    ("https://www.spam-farm.example.org/en/5", 1),
    ("http://link-farm.example.com/en/1", 1),
    ("https://seo-spam.example.net/es/2", 1),
    ("http://adult-x.example.org/fr/16", 1),
    ("https://m.adult-cams.example.com/en/7", 1),
    ("http://hot-adult.example.net/video/1", 1),
    ("http://m.ads-track.example.com/en/4", 1),
    ("https://ads-click.example.net/r?u=1", 1),
    ("http://track-ads.example.org/pixel", 1),
    ("https://payday-loan.example.com/apply", 1),
    ("http://win-prize.example.net/claim", 1),
    ("https://ththon.example.com/en/17", 0),
    ("http://blog.tionsh.example.com/fr/74.html", 0),
    ("https://www.therst.example.net/fr/41", 0),
    ("http://m.theron.example.net/de/59", 0),
    ("https://tionble.example.org/en/482/", 0),
    ("http://ththea.example.org/en/76", 0),
    ("https://blog.theror.example.com/de/13", 0),
    ("http://www.ththst.example.com/en/18/", 0),
    ("https://therhe.example.org/es/84", 0),
    ("http://tiontion.example.net/en/78", 0),
    ("https://library.example.org/catalogue/history", 0),
    ("http://news.example.com/2020/05/weather.html", 0),
    ("https://docs.example.net/guide/install", 0),
    ("http://www.university.example.org/physics/notes", 0),
    ("https://museum.example.com/en/paintings", 0),
    ("http://recipes.example.net/bread/rye", 0),
    ("https://city-council.example.org/minutes/12", 0),
    ("http://open-data.example.com/tables/4", 0),
    ("https://garden-club.example.net/roses", 0),
    ("http://book-review.example.com/novels/8", 0),
]

RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def split_url(url):
    """(host, path) expressions of a URL column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), empty), F.coalesce(path, empty)


def longest_rule(host, path, rules):
    """Struct (rule, verdict) of the longest rule that fits, null if none does."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True)[::-1]:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def features(hosts: list[str], paths: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed n-gram) of all n-grams; host and path are kept apart and marked at both ends."""
    rows, hashed = [], []
    for kind, words in ((0x68, hosts), (0x70, paths)):
        coded = [b"^" + w.encode() + b"$" if w else b"" for w in words]
        length = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(coded)), length)
        for n in GRAMS:
            m = len(flat) - n + 1
            if m <= 0:
                continue
            h = np.full(m, kind * 8 + n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + flat[k : k + m]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            inside = owner[:m] == owner[n - 1 :]
            rows.append(owner[:m][inside])
            hashed.append((h >> np.uint64(64 - bits)).astype(np.int64)[inside])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(hashed)


def logits(hosts: list[str], paths: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """Mean weight of a URL's n-grams, scaled by the root of their number, plus the bias."""
    row, gram = features(hosts, paths)
    n = np.maximum(np.bincount(row, minlength=len(hosts)), 1)
    return np.bincount(row, weights[gram], minlength=len(hosts)) / np.sqrt(n) + bias


def plain_split(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    path = rest[end:].partition("?")[0].partition("#")[0]
    return rest[:end].lower(), path


def fit(labelled=None, steps: int = 400, rate: float = 0.5, shrink: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent with weight decay over all labelled rows."""
    labelled = LABELLED if labelled is None else labelled
    hosts, paths = zip(*(plain_split(u) for u, _ in labelled), strict=True)
    y = np.array([v for _, v in labelled], float)
    row, gram = features(list(hosts), list(paths))
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    w, b = np.zeros(1 << BITS), 0.0
    for _ in range(steps):
        z = np.bincount(row, w[gram], minlength=len(y)) * scale + b
        g = 1 / (1 + np.exp(-z)) - y
        w -= rate * (np.bincount(gram, (g * scale)[row], minlength=len(w)) + shrink * w)
        b -= rate * g.mean()
    return w, b


def judge(pages: DataFrame, rules=RULES, labelled=None, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score); ``score`` is the model's for every URL."""
    weights, bias = fit(labelled)

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-logits(host.tolist(), path.tolist(), weights, bias))))

    host, path = split_url(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).select("page_id", host.alias("host"), path.alias("path"))
    hit = longest_rule(F.col("host"), F.col("path"), rules)
    scored = parts.withColumn("hit", hit).withColumn("score", score("host", "path"))
    model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), model).alias("verdict"), "score")


@query("op6_url_filter")
def op6(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))
