"""Which strings contain which, as equi-joins on grams.

A needle is looked up under the one of its trigrams that the fewest haystacks have (itself, if it is shorter), so
a haystack is sent once for each of its grams, not for each of its substrings, and common grams are hardly used.
Where a key has few needles and not too many haystacks, they meet on the key instead: comparing a haystack
with ``FEW`` needles costs no more than sending its grams, and each text is sent once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cut import cut

GRAM = 3
FEW, MANY = 64, 16_384  # needles and haystacks of a key that meet on the key


def _grams(text: str, size: int) -> Column:
    """Different grams of a text that is at least ``size`` long."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (size - 1)), lambda i: F.substring(F.col(text), i, F.lit(size))))


def containment(needles: DataFrame, haystacks: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Different (key, needle, hay) with ``needle`` inside ``hay``; both sides have the key columns. Empty needles
    and NULLs are in nothing."""
    key = list(key)
    n = needles.select(*key, "needle").where(F.length("needle") > 0).distinct()
    h = haystacks.select(*key, "hay").where(F.length("hay") > 0).distinct()
    if not key:
        return _by_grams(n, h, key)
    count = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    sizes = count(n, "_needles").join(count(h, "_hays"), key)
    small = (F.col("_needles") <= FEW) & (F.col("_hays") <= MANY)
    large = cut(sizes.where(~small).select(*key))  # keys with many texts: few, and mostly none
    met = n.join(large, key, "left_anti").join(h.join(large, key, "left_anti"), key).where(F.contains("hay", "needle"))
    met = met.select(*key, "needle", "hay")
    if large.isEmpty():
        return met
    return met.unionByName(_by_grams(n.join(large, key, "left_semi"), h.join(large, key, "left_semi"), key))


def _by_grams(n: DataFrame, h: DataFrame, key: list[str]) -> DataFrame:
    sizes = [F.when(F.length("hay") >= g, _grams("hay", g)).otherwise(F.array().cast("array<string>")) for g in range(1, GRAM + 1)]
    index = h.select(*key, "hay", F.explode(F.concat(*sizes)).alias("gram"))
    own = F.when(F.length("needle") < GRAM, F.array("needle")).otherwise(_grams("needle", GRAM))
    asked = n.select(*key, "needle", F.explode(own).alias("gram"))
    used = index.join(asked.select(*key, "gram").distinct(), [*key, "gram"], "left_semi")
    rarity = used.groupBy(*key, "gram").agg(F.count("*").alias("_n"))
    best = asked.join(rarity, [*key, "gram"], "left").groupBy(*key, "needle").agg(
        F.max(F.col("_n").isNull()).alias("_gone"), F.min_by("gram", F.struct("_n", "gram")).alias("gram")
    )
    best = best.where(~F.col("_gone")).drop("_gone")  # a gram that no haystack has rules the needle out
    return best.join(used, [*key, "gram"]).where(F.contains("hay", "needle")).select(*key, "needle", "hay")
