"""Lookup by containment in both directions: the key holds a code of the table, or a code holds the key.

Neither side is compared with all of the other. A code is posted under its first `GRAM` characters, so a key that holds it has that gram
among its own; a key within a code has its first gram among the code's. Candidates of these equi-joins are verified by `contains`. A gram that
very many codes begin with is a skewed join key that Spark splits; strings shorter than a gram are posted under each length below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 4


def grams(c: Column, most: int = GRAM) -> Column:
    """All substrings of 1 to `most` characters that a posting may stand under: those of `most`, and all shorter ones."""
    one = lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    out = one(1)
    for n in range(2, most + 1):
        out = F.array_union(out, one(n))
    return F.array_distinct(out)


def posting(c: Column) -> Column:
    """The first `GRAM` characters; all of a shorter string."""
    return F.substring(c, 1, GRAM)


def contained(keys: DataFrame, codes: DataFrame) -> DataFrame:
    """(key, code) of all pairs of distinct non-empty keys (key) and codes (code) of which one holds the other."""
    k, c = keys.select("key").where("key <> ''").distinct(), codes.select("code").where("code <> ''").distinct()
    inside = k.select("key", F.explode(grams(F.col("key"))).alias("g")).join(c.select("code", posting(F.col("code")).alias("g")), "g").where(F.contains("key", F.col("code")))
    around = c.select("code", F.explode(grams(F.col("code"))).alias("g")).join(k.select("key", posting(F.col("key")).alias("g")), "g").where(F.contains("code", F.col("key")))
    return inside.select("key", "code").union(around.select("key", "code")).distinct()


def lookup(keys: DataFrame, codes: DataFrame, order: str | None = None) -> DataFrame:
    """(key, code, how): for each distinct key the code that equals it, else of those that hold it or that it holds the first by `order` (a column of codes) or, without one, the longest; ties by code."""
    rank = F.col(order) if order else -F.length("code")
    ranked = codes.select("code", rank.alias("rank"))
    found = contained(keys, codes).join(ranked, "code")
    best = found.groupBy("key").agg(F.min(F.struct((F.col("key") != F.col("code")).alias("other"), "rank", "code")).alias("b"))
    how = F.when(~F.col("b.other"), "exact").when(F.contains("key", F.col("b.code")), "holds").otherwise("within")
    return best.select("key", F.col("b.code").alias("code"), how.alias("how"))
