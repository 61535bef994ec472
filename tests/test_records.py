"""Record lives: milliseconds as DuckDB has them, in the result and where a timer is due."""

import random
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusloom.plans.registry import ORACLE_SQL, QUERIES
from corpusloom.streaming import records


def test_milliseconds_are_rounded(spark):
    micros = [1704067207179575, 1704067207179499, 1704067207179500, 0, -500, -1499, -1501]
    got = spark.createDataFrame([(u,) for u in micros], "u long").select(records.to_millis(F.timestamp_micros("u")).alias("ms"))
    assert [r["ms"] for r in got.collect()] == [1704067207180, 1704067207179, 1704067207180, 0, -1, -1, -2]


def test_lives_match_sql_to_the_millisecond(spark, tmp_path):
    end, before = datetime(2024, 3, 1), timedelta(days=13, hours=1)
    at = [end, *(end - before + timedelta(microseconds=u) for u in (-501, -500, -1, 0, 1, 499, 500, 501, 999))]
    rows = [(k, ts, k + 1, "error" if k % 2 else "click") for k, ts in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, QUERIES["record_lives"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(con.execute(ORACLE_SQL["record_lives"]).fetchall())
    assert {r[5] for r in got} == {True, False}


def test_states_are_kept_by_group(spark, tmp_path):
    """Many records have no more states in the store than there are groups; each has the fate that its outcomes give it, in whatever order they land, the null key too."""
    r, day = random.Random(5), datetime(2024, 3, 1)
    outcomes = [(r.choice([None, *range(-300, 300)]), day + timedelta(seconds=r.randrange(90000)), k, r.choice(["success", "corrupted", "failed"])) for k in range(1500)]
    schema = "key long, ts timestamp, id long, outcome string"
    sink, landing = f"{tmp_path}/sink", f"{tmp_path}/landing"
    for part in range(3):
        spark.createDataFrame(outcomes[part::3], schema).coalesce(1).write.mode("append").parquet(landing)
        records.track(spark, landing, spark.createDataFrame([], schema).schema, sink, f"{tmp_path}/checkpoint", late="2 days", most=4, groups=8)
    got = {x.key: x for x in records.latest(spark.read.schema(f"{records.OUT}, trigger long").parquet(sink)).collect()}
    want = {}
    for key in {o[0] for o in outcomes}:
        own = sorted(o[1:] for o in outcomes if o[0] == key)
        bad = sum(o != "success" for _, _, o in own)
        status = "success" if bad < len(own) else "lost" if bad >= 4 else own[-1][2]
        want[key] = Row(key=key, n=len(own), status=status, attempts=bad, last=own[-1][0], due=False)
    assert got == want and len(got) > 500
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        assert spark.read.format("statestore").option("stateVarName", "records").load(f"{tmp_path}/checkpoint").count() == 8
    finally:
        spark.conf.unset(provider)


def test_one_timer_of_a_group_marks_each_record_in_its_turn(spark, tmp_path):
    """All records in one group: a mark comes when the watermark passes, goes with a later outcome, and later timers still follow."""
    day = datetime(2024, 3, 1)
    at = lambda h: day + timedelta(hours=h)
    schema, sink, landing = "key long, ts timestamp, id long, outcome string", f"{tmp_path}/sink", f"{tmp_path}/landing"
    seen = []
    for part in ([(1, at(0), 1, "failed"), (2, at(3), 2, "corrupted"), (3, at(0), 3, "success")], [(4, at(3), 4, "failed")], [(1, at(3), 5, "failed"), (5, at(6), 6, "failed")], [(6, at(12), 7, "success")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(landing)
        records.track(spark, landing, spark.createDataFrame([], schema).schema, sink, f"{tmp_path}/checkpoint", late="1 hour", groups=1)
        seen.append(sorted(x.key for x in records.latest(spark.read.schema(f"{records.OUT}, trigger long").parquet(sink)).where("due").collect()))
    assert seen == [[1], [1], [1, 2, 4], [1, 2, 4, 5]]
    changes = spark.read.schema(f"{records.OUT}, trigger long").parquet(sink).where("key = 1").orderBy("trigger").collect()
    assert [(x.n, x.due) for x in changes] == [(1, False), (1, True), (2, False), (2, True)]
