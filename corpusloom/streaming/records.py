"""The life of records under late and disordered outcomes: a stateful stream with timers.

Every record has one state, kept by the stream across triggers and restarts. An outcome is (key, ts, id, outcome). Outcomes of a record arrive in any order and any split into
triggers, so its state holds only what does not depend on order: whether one was a success, the latest other one, how many there were, and when the last came.

A record is `success` once any outcome is; else it has the status of its latest outcome, `corrupted` or `failed`. A record without success is to be tried
again `delay` after its last outcome: a timer in event time marks it `due` when the watermark passes that time, and a later outcome takes the mark away.
After `most` attempts it is `lost` instead and is tried no more. An outcome that comes after later ones by more than the allowed lateness is dropped by Spark, so
lateness has to cover the disorder of the landing folder; states are never dropped. The watermark and timers go by times rounded to the millisecond.

Records are dealt by hash to `groups`, each with one state that holds the packed states of its records and one timer, at the earliest time that one of them is due; calls of
the state store are made for each group, not for each record, and numpy merges a group's outcomes into its records. A checkpoint goes with its number of groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key long, n long, status string, attempts long, last timestamp, due boolean"
CHANGES = OUT.replace("last timestamp", "last long")  # microseconds
STATE = "records binary, timer long"
RECORD = [("void", "?"), ("key", "<i8"), ("n", "<i8"), ("success", "?"), ("attempts", "<i8"), ("last", "<i8"), ("last_id", "<i8"), ("corrupted", "?"), ("due", "?")]  # void: the key is null
GROUPS = 1024
NEVER = -1


def to_millis(ts: Column) -> Column:
    """Milliseconds since 1970, halves away from it."""
    return (F.round(F.unix_micros(ts), -3) / 1000).cast("long")


def merged(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The records of both, one of each key, and which of them are in new. Of outcomes that came at the same time under the same id the first one seen is the last."""
    both = np.concatenate([old, new])[::-1]
    order = np.lexsort((both["last_id"], both["last"], both["key"], both["void"]))
    both, fresh = both[order], (np.arange(len(both))[::-1] >= len(old))[order]
    start = np.flatnonzero(np.append(True, (both["key"][1:] != both["key"][:-1]) | (both["void"][1:] != both["void"][:-1])))
    out = both[np.append(start[1:], len(both)) - 1]
    for c, add in (("n", np.add), ("attempts", np.add), ("success", np.logical_or)):
        out[c] = add.reduceat(both[c], start)
    out["due"] = np.logical_or.reduceat(both["due"], start)
    return out, np.logical_or.reduceat(fresh, start)


class Records(StatefulProcessor):
    """All records of a group."""

    def __init__(self, delay_ms: int, most: int):
        self.delay_ms, self.most = delay_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("records", STATE)

    def load(self) -> tuple[np.ndarray, int]:
        s = self.state.get()
        return (np.frombuffer(bytes(s[0]), RECORD), s[1]) if s else (np.empty(0, RECORD), NEVER)

    def settle(self, records: np.ndarray, changed: np.ndarray, timer: int, watermark: int) -> Iterator:
        """Marks what is due at the watermark, stores the records with the timer of the next one, and yields those that changed."""
        import pandas as pd

        again = np.sign(records["last"]) * ((np.abs(records["last"]) + 500) // 1000) + self.delay_ms
        open_ = ~records["success"] & (records["attempts"] < self.most)
        due = open_ & (again <= watermark)
        r = records.copy()
        r["due"] = due
        waits = again[open_ & ~due]
        following = int(waits.min()) if len(waits) else NEVER
        if following != timer:
            if timer > watermark:  # Spark takes away those that are past
                self.handle.deleteTimer(timer)
            if following != NEVER:
                self.handle.registerTimer(following)
        self.state.update((r.tobytes(), following))
        r = r[changed | (due != records["due"])]
        if len(r):
            status = np.select([r["success"], r["attempts"] >= self.most, r["corrupted"]], ["success", "lost", "corrupted"], "failed")
            key = pd.Series(r["key"], dtype="Int64").mask(r["void"])
            yield pd.DataFrame({"key": key, "n": r["n"], "status": status.astype(object), "attempts": r["attempts"], "last": r["last"], "due": r["due"]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        records, timer = self.load()
        parts = []
        for batch in rows:
            new = np.zeros(len(batch), RECORD)
            new["n"] = 1
            new["attempts"] = ~batch["success"].to_numpy(bool)
            for c in ("void", "key", "success", "last", "last_id", "corrupted"):
                new[c] = batch[c].to_numpy()
            parts.append(new)
        records, changed = merged(records, np.concatenate(parts))
        yield from self.settle(records, changed, timer, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        records, timer = self.load()
        yield from self.settle(records, np.zeros(len(records), bool), timer, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def lives(outcomes: DataFrame, late: str, delay_s: int, most: int, groups: int = GROUPS) -> DataFrame:
    """A stream of (key, n, status, attempts, last, due): each change of a record of the stream (key, ts, id, outcome); n counts the outcomes that it rests on."""
    ts, key = F.col("ts").cast("timestamp"), F.col("key").cast("long")
    is_ = lambda x: F.coalesce(F.col("outcome") == x, F.lit(False))
    rows = outcomes.select(
        F.pmod(F.xxhash64(key), F.lit(groups)).alias("part"), F.timestamp_millis(to_millis(ts)).alias("at"), key.isNull().alias("void"), F.coalesce(key, F.lit(0)).alias("key"),
        F.unix_micros(ts).alias("last"), F.col("id").cast("long").alias("last_id"), is_("success").alias("success"), is_("corrupted").alias("corrupted"),
    )
    keyed = rows.withWatermark("at", late).groupBy("part")
    changes = keyed.transformWithStateInPandas(statefulProcessor=Records(1000 * delay_s, most), outputStructType=CHANGES, outputMode="Update", timeMode="EventTime")
    return changes.withColumn("last", F.timestamp_micros("last"))


def track(spark: SparkSession, landing: str, schema, sink: str, checkpoint: str, outcomes=lambda df: df, late: str = "1 hour", delay_s: int = 3600, most: int = 3, files_per_trigger: int = 1, groups: int = GROUPS) -> None:
    """Carry all that landed since the last call through the records' states; returns when it is done. Each trigger's changes lie below the sink under its number, so one that is repeated is written over."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the only one that has timers
    try:
        stream = outcomes(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(landing))
        query = (
            lives(stream, late, delay_s, most, groups).writeStream.outputMode("update")
            .foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{sink}/trigger={k}"))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)


def latest(changes: DataFrame) -> DataFrame:
    """The last state of each record among its changes."""
    best = changes.groupBy("key").agg(F.max_by(F.struct("n", "status", "attempts", "last", "due"), F.struct("n", "trigger")).alias("r"))
    return best.select("key", "r.*")
