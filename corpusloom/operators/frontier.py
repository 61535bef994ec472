"""Crawl frontiers: a fixpoint over a table of links.

Each round takes the links of the pages that the last one reached, anti-joins those reached before, and writes what is new below the
shared folder, until nothing is new or the depth is spent. So cycles end, a page that is linked at several levels comes once, at its least depth,
and a lost executor costs one round. Rounds are as many as the longest shortest path; only new pages move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_links(links: DataFrame, fan_out: int, order: str = "pos") -> DataFrame:
    """The first `fan_out` links (src, dst) of each page."""
    at = F.row_number().over(Window.partitionBy("src").orderBy(order, "dst"))
    return links.withColumn("_at", at).where(F.col("_at") <= fan_out).select("src", "dst")


def crawl(links: DataFrame, seeds: DataFrame, new_folder: Callable[[], str], depth: int | None = None, fan_out: int | None = None, follow: Column | None = None, stop: Callable[[DataFrame], bool] | None = None) -> DataFrame:
    """(page, depth) of all that `seeds` (page) reach over links (src, dst, pos).

    Of each page the first `fan_out` links count. `follow` is a condition on src and dst; `stop` sees each round's new pages and ends the crawl if it holds; `depth`
    bounds the levels. Null pages go. `new_folder()` names a new folder that driver and executors share.
    """
    spark = links.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        at = new_folder()
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    used = first_links(links, fan_out) if fan_out is not None else links.select("src", "dst")
    used = kept((used.where(follow) if follow is not None else used).where("src is not null and dst is not null").distinct())
    new = kept(seeds.select("page").where("page is not null").distinct().withColumn("depth", F.lit(0)))
    seen, level = new, 0
    while (depth is None or level < depth) and new.limit(1).count() and not (stop and stop(new)):
        level += 1
        reached = used.join(new.select(F.col("page").alias("src")), "src").select(F.col("dst").alias("page")).distinct()
        new = kept(reached.join(seen.select("page"), "page", "left_anti").withColumn("depth", F.lit(level)))
        seen = seen.unionByName(new)
    return seen
