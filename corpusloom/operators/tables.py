"""Keyed-table operators: first and last of a key, upsert, idempotent append, top n, streaks, checks of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, if it has all columns; ValueError names the missing ones."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order. Keys that are long texts are hashed for the shuffle and compared after it."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: an aggregate, so keys with many rows are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert_new(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows as they are, and the new rows with unseen keys."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"))


def append_new(sink: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of a batch to append: one a key, and only keys that the sink has not."""
    return keep_first(batch, [key], [order]).join(sink.select(key), key, "left_anti")


def top_n(df: DataFrame, group: list[str], order: list[Column | str], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def numbered(df: DataFrame, order: list[Column | str], place: str, folder: str) -> DataFrame:
    """All rows with their place (from 1) in the given order, which should have no ties, without one task seeing all rows.

    Rows are range-partitioned and written below `folder` with the number of their range, so that a retry cannot deal them anew;
    a row's place is its rank in its range after the rows of the ranges before.
    """
    df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(folder)
    kept = df.sparkSession.read.parquet(folder)
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))  # one row a range
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return kept.join(F.broadcast(before), "_part").withColumn(place, F.col("_before") + own).drop("_part", "_before")


def until_streak(pages: DataFrame, order: str, empty: Column, length: int, folder: str) -> DataFrame:
    """Pages up to and with the one that completes `length` empty ones in a row. `order` has no ties; `folder` is new and shared.

    Every empty page counts for itself and the length - 1 places behind it: the first place with `length` counts completes the streak.
    """
    d = numbered(pages.withColumn("_empty", empty), [order], "_place", folder)
    counts = d.where("_empty").select(F.explode(F.sequence("_place", F.col("_place") + (length - 1))).alias("_place")).groupBy("_place").agg(F.count(F.lit(1)).alias("_n"))
    stop = counts.where(F.col("_n") == length).agg(F.min("_place").alias("_stop"))
    return d.join(F.broadcast(stop)).where(F.col("_stop").isNull() | (F.col("_place") <= F.col("_stop"))).drop("_empty", "_place", "_stop")


def until_true(pages: DataFrame, order: str, stop: Column) -> DataFrame:
    """Pages up to and with the first one where `stop` holds."""
    first = pages.where(stop).agg(F.min(order).alias("_stop"))
    return pages.join(F.broadcast(first)).where(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_stop")


def children_text(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, order: list[str], text: str, line: str) -> DataFrame:
    """Parents with the texts of their children in order, joined by a separating line; parents without children keep null."""
    parts = children.groupBy(child_key).agg(F.array_sort(F.collect_list(F.struct(*order, text))).alias("_c"))
    joined = parts.select(F.col(child_key).alias(parent_key), F.array_join(F.transform("_c", lambda c: c[text]), line).alias("merged"), F.size("_c").alias("n_children"))
    return parents.join(joined, parent_key, "left")


def select_present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that df has, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def within(points: DataFrame, intervals: DataFrame, key: str, at: str, low: str, high: str) -> DataFrame:
    """Points with the intervals (low, high] of the same key that hold them: an equi-join with a range condition."""
    return points.join(intervals, key).where((F.col(at) > F.col(low)) & (F.col(at) <= F.col(high)))
