"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import lexicon as L
from corpusloom.operators import tables as T
from corpusloom.plans import fixture as X
from corpusloom.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}" if math.isfinite(float(v)) else str(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    """Every column of every row is computed; names do not repeat."""
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns) and (rows or name == "similarity_flag")


def test_keyword_patterns(spark, duck):
    texts = [(t or "").lower() for (t,) in duck.execute("SELECT text FROM documents").fetchall()]
    want = {k: sum(bool(re.search(L.keyword_pattern(k), t, re.ASCII)) for t in texts) for _, _, k in X.ROWS}
    assert {r["keyword"]: r["n_docs"] for r in QUERIES["keyword_patterns"](spark, SF).collect()} == want


def test_sample_meets_quota(spark):
    keys = ["stance", "year", "source"]
    quota = {tuple(r[k] for k in keys): r["quota"] for r in QUERIES["stratified_quota"](spark, SF).collect()}
    rows = QUERIES["stratified_sample"](spark, SF).collect()
    assert len({r["o_orderkey"] for r in rows}) == len(rows)
    drawn = Counter(tuple(r[k] for k in keys) for r in rows)
    assert drawn == Counter({k: n for k, n in quota.items() if n})


def test_numbered(spark, tmp_path):
    """Places are those of one global order, over several ranges and with null keys."""
    d = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("id"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("y"))
    order = [F.col("y").asc_nulls_last(), F.col("id").asc()]
    got = [(r["y"], r["id"], r["place"]) for r in T.numbered(d, order, "place", str(tmp_path / "a")).collect()]
    want = sorted(((r["y"], r["id"]) for r in d.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert sorted(got, key=lambda r: r[2]) == [(*r, k + 1) for k, r in enumerate(want)]
    assert T.numbered(d.where("id < 0"), order, "place", str(tmp_path / "b")).count() == 0
