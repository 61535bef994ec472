"""Sinks: CSV, one text a document, partitions by year, summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_name
from ..operators.tables import append_new, upsert_new


def write_csv(df: DataFrame, path: str, order: list | None = None, single: bool = False, bom: bool = False) -> None:
    """With header, quotes doubled; `single` makes one file (for small results); `bom` starts each file with a byte-order mark."""
    out = df.orderBy(*order) if order else df
    out = out.toDF("\ufeff" + df.columns[0], *df.columns[1:]) if bom else out
    (out.coalesce(1) if single else out).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def document_block(fields: list[tuple[str, Column]], body: Column, rule: str = "=" * 70) -> Column:
    """`Key: value` lines, a rule, the body."""
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in fields]
    return F.concat_ws("\n", *lines, F.lit(rule), F.coalesce(body, F.lit("")))


def write_documents(df: DataFrame, path: str, id_col: str, block: Column) -> None:
    """One folder a document below its safe name, written by the cluster."""
    df.select(safe_name(F.col(id_col).cast("string")).alias("name"), block.alias("value")).write.mode("append").partitionBy("name").text(path)


def write_by_year(df: DataFrame, path: str, year: str = "year", sentinel: str = "unknown_year") -> DataFrame:
    """Partitions by year; returns the manifest of counts, the sentinel last."""
    df.withColumn(year, F.coalesce(F.col(year).cast("string"), F.lit(sentinel))).write.mode("overwrite").partitionBy(year).parquet(path)
    return df.groupBy(year).count().orderBy(F.col(year) == sentinel, year)


def upsert_manifest(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return upsert_new(existing, new, key).orderBy(key)


def new_documents(df: DataFrame, path: str, key: str, order: str) -> DataFrame:
    """The rows of df whose key the sink at `path` has not; one a key."""
    spark = df.sparkSession
    try:
        sink = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        sink = spark.createDataFrame([], df.schema)
    return append_new(sink, df, key, order)


def append_documents(df: DataFrame, path: str, key: str, order: str) -> None:
    """Append the rows whose key the sink has not; one a key."""
    new_documents(df, path, key, order).write.mode("append").parquet(path)


def summary_json(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """One row: a JSON object with the total and the counts of each dimension."""
    parts = [df.agg(F.count(F.lit(1)).alias("total"))]
    for c in dimensions:
        n = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        entries = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(c).cast("string"), F.lit("")).alias("k"), "n")))
        parts.append(n.agg(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["k"], e["n"]))).alias(c)))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    return out.select(F.to_json(F.struct("total", *dimensions)).alias("summary"))


def export_status(text: Column, score: Column, least_chars: int = 200, least_score: float = 0.3) -> Column:
    """The status ladder of an export."""
    return F.when(F.coalesce(score, F.lit(1.0)) < least_score, "invalid_low_score").when(text.isNull(), "missing").when(F.length(text) < least_chars, "too_short").otherwise("success")


def save_batch(df: DataFrame, path: str, key: str, order: str) -> dict[str, int]:
    """Append a batch and return how many rows came, and how many were written or skipped.

    The new rows are written beside the sink under an id of their own and counted there, so the count reads the batch alone and a second
    writer does not change it; then they are appended.
    """
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.batch-{uuid.uuid4().hex}"
    new_documents(df, path, key, order).write.parquet(staged)
    batch = spark.read.schema(df.schema).parquet(staged)
    written, came = batch.count(), df.count()
    batch.write.mode("append").parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return {"came": came, "written": written, "skipped": came - written}


def report(title: str, rows: list[tuple[str, object]], rule: str = "=" * 60) -> str:
    """A plain-text report of a few collected figures."""
    width = max((len(k) for k, _ in rows), default=0)
    return "\n".join([rule, title, rule, *[f"{k.ljust(width)}  {v}" for k, v in rows]]) + "\n"
