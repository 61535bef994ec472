"""Queries of stateful streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import records
from .registry import query, table
from .shared import shared_folder

LATE_DAYS, DELAY_S, MOST = 13, 3600, 3


def outcomes(events):
    """A user's events of one day are the outcomes of one record: a purchase is a success, an error a corrupted answer, all else a failure."""
    outcome = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "corrupted").otherwise("failed")
    return events.select((F.col("user_id") * 1000 + F.dayofyear("ts")).alias("key"), "ts", F.col("event_id").alias("id"), outcome.alias("outcome"))


@query(
    "record_lives",
    f"""WITH o AS (SELECT user_id * 1000 + dayofyear(ts) AS key, ts, event_id AS id, event_type = 'purchase' AS ok, event_type = 'error' AS bad FROM events),
r AS (SELECT key, count(*) AS n, bool_or(ok) AS ok, count(*) FILTER (NOT ok) AS attempts, max(ts) AS last, arg_max(bad, (ts, id)) AS bad FROM o GROUP BY key)
SELECT key, n, CASE WHEN ok THEN 'success' WHEN attempts >= {MOST} THEN 'lost' WHEN bad THEN 'corrupted' ELSE 'failed' END AS status, attempts, epoch_ms(last) AS last_ms,
 NOT ok AND attempts < {MOST} AND epoch_ms(last) + {DELAY_S * 1000} <= epoch_ms((SELECT max(ts) FROM events)) - {LATE_DAYS} * 86400000 AS due FROM r""",
)
def record_lives(spark, sf):
    """Events land up to two days late, in parts of ten days; a stream with timers carries them through their records' states, is ended half way, and resumes."""
    base = shared_folder(spark, "records")
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    arrival = F.floor((F.unix_timestamp("ts") + F.col("event_id") % 48 * 3600) / (10 * 86400))
    staged = events.withColumn("part", arrival)
    staged.write.partitionBy("part").parquet(f"{base}/staged")
    staged = spark.read.parquet(f"{base}/staged")
    parts = sorted(r["part"] for r in staged.select("part").distinct().collect())  # one for each ten days
    for some in (parts[: len(parts) // 2], parts[len(parts) // 2 :]):
        for part in some:
            staged.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{base}/landing")
        if some:
            records.track(spark, f"{base}/landing", events.schema, f"{base}/sink", f"{base}/checkpoint", outcomes, f"{LATE_DAYS} days", DELAY_S, MOST, files_per_trigger=1000)
    found = records.latest(spark.read.schema(f"{records.OUT}, trigger long").parquet(f"{base}/sink")) if parts else spark.createDataFrame([], records.OUT)
    return found.select("key", "n", "status", "attempts", records.to_millis(F.col("last")).alias("last_ms"), "due")
