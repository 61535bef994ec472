"""Queries of strata, quotas, samples and splits, over orders as strata of status, year and priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as S
from .registry import query, table

KEYS = ["stance", "year", "source"]
STRATA = "o AS (SELECT o_orderkey, o_orderstatus AS stance, year(o_orderdate)::INT AS year, o_orderpriority AS source FROM orders)"


def rows(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("stance"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("source"))


@query("strata_counts", f"WITH {STRATA} SELECT stance, year, source, count(*) AS n FROM o GROUP BY ALL")
def strata_counts(spark, sf):
    return S.strata(rows(spark, sf), KEYS)


@query("stratified_quota")
def stratified_quota(spark, sf):
    return S.quota_table(spark, rows(spark, sf), KEYS)


@query("stratified_sample")
def stratified_sample(spark, sf):
    d = rows(spark, sf)
    return S.draw(d, S.quota_table(spark, d, KEYS), KEYS, "o_orderkey")


@query("stratified_sample_fixed", f"WITH {STRATA}, r AS (SELECT *, row_number() OVER (PARTITION BY stance, year, source ORDER BY md5('42:' || o_orderkey::VARCHAR), o_orderkey) AS n FROM o) SELECT o_orderkey, stance, year, source FROM r WHERE n <= 3")
def stratified_sample_fixed(spark, sf):
    """Three of each stratum."""
    d = rows(spark, sf)
    return S.draw(d, S.strata(d, KEYS).withColumn("quota", F.lit(3)), KEYS, "o_orderkey").select("o_orderkey", *KEYS)


@query("blind_template", f"WITH {STRATA}, r AS (SELECT *, row_number() OVER (PARTITION BY stance, year, source ORDER BY md5('42:' || o_orderkey::VARCHAR), o_orderkey) AS n FROM o) SELECT 'S' || lpad(row_number() OVER (ORDER BY o_orderkey)::VARCHAR, 4, '0') AS sample_id, o_orderkey, year, source, '' AS human_stance FROM r WHERE n = 1")
def blind_template(spark, sf):
    d = rows(spark, sf)
    drawn = S.draw(d, S.strata(d, KEYS).withColumn("quota", F.lit(1)), KEYS, "o_orderkey")
    return S.blind(drawn, ["o_orderkey"], ["stance"]).select("sample_id", "o_orderkey", "year", "source", "human_stance")


SPLIT = f"{STRATA}, r AS (SELECT *, count(*) OVER (PARTITION BY stance, year) AS n, row_number() OVER (PARTITION BY stance, year ORDER BY md5('42:' || o_orderkey::VARCHAR), o_orderkey) AS i FROM o), p AS (SELECT o_orderkey, stance, year, CASE WHEN i <= greatest(floor(n * 0.7::DOUBLE + 0.5::DOUBLE), 1) THEN 'train' WHEN i <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE) + 0.5::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r)"


@query("stratified_split", f"WITH {SPLIT} SELECT o_orderkey, split FROM p")
def stratified_split(spark, sf):
    return S.split(rows(spark, sf), ["stance", "year"], "o_orderkey").select("o_orderkey", "split")


@query("split_distribution", f"WITH {SPLIT} SELECT split, stance, year, count(*) AS n FROM p GROUP BY GROUPING SETS ((split, stance), (split, year), (split))")
def split_distribution(spark, sf):
    d = S.split(rows(spark, sf), ["stance", "year"], "o_orderkey")
    return d.groupingSets([["split", "stance"], ["split", "year"], ["split"]], "split", "stance", "year").agg(F.count(F.lit(1)).alias("n"))
