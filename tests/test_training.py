"""The training loop against plain numpy; resume and early stop."""

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import training as R

WORDS = {"a": "good fine nice calm", "b": "bad poor awful grim", "c": "blue green red pink"}


def rows(spark, n=240):
    data = []
    for i in range(n):
        label = "abc"[i % 3]
        own = WORDS[label].split()
        text = " ".join([own[i % 4], "word", f"n{i % 7}", "noise" if i % 5 else own[(i + 1) % 4]])
        data.append((i, text if i else None, label if i != 5 else "abc"[(i + 1) % 3], "train" if i % 4 else "held"))
    return spark.createDataFrame([*data, (900, "x", "never", "held"), (901, "y", None, "train")], "id long, text string, label string, split string")


def test_loop_matches_numpy(spark, tmp_path):
    folder, features = str(tmp_path / "m"), 256
    labels = R.prepare(rows(spark), folder, "id", "split", features=features)
    assert labels == ["a", "b", "c"]
    run = R.fit(spark, folder, labels, epochs=3, steps=2, patience=9, features=features)
    table = spark.read.parquet(f"{folder}/features").withColumns({f"s{e}": F.pmod(F.xxhash64("id", F.lit(e)), F.lit(2)) for e in range(3)}).collect()
    x = np.zeros((len(table), features + 1))
    for k, r in enumerate(table):
        x[k, r["idx"]], x[k, -1] = r["val"], 1
    y, w, train = np.array([r["y"] for r in table]), np.array([r["weight"] for r in table]), np.array([r["split"] == "train" for r in table])
    weights = velocity = np.zeros((features + 1, 3))
    history = []
    for epoch in range(3):
        for step in range(2):
            some = train & np.array([r[f"s{epoch}"] == step for r in table])
            z = x[some] @ weights
            p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True) - np.eye(3)[y[some]]
            velocity = 0.9 * velocity - 4.0 * (x[some].T @ (p * w[some, None]) / w[some].sum() + 1e-5 * weights)
            weights = weights + velocity
        guess = (x[~train] @ weights).argmax(axis=1)
        f1 = [2 * ((guess == k) & (y[~train] == k)).sum() / max(1, (guess == k).sum() + (y[~train] == k).sum()) for k in range(3)]
        history.append((epoch, float(np.mean(f1))))
        if epoch == run.best:
            assert np.allclose(run.weights, weights, atol=1e-6)
    assert [e for e, _ in run.history] == [0, 1, 2] and np.allclose([f for _, f in run.history], [f for _, f in history])
    assert run.history[run.best][1] == max(f for _, f in run.history) > 0.9


def test_resumed_run_is_equal(spark, tmp_path):
    """Stopped after one epoch and taken up again: the very same weights, with other shuffles and task orders."""
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    for folder in (whole, parts):
        labels = R.prepare(rows(spark), folder, "id", "split", features=256)
    a = R.fit(spark, whole, labels, epochs=4, steps=2, patience=9, features=256)
    for epochs in (1, 3, 4):
        b = R.fit(spark, parts, labels, epochs=epochs, steps=2, patience=9, features=256)
    assert a.history == b.history and a.best == b.best and np.array_equal(a.weights, b.weights)


def test_early_stop(spark, tmp_path):
    """Held-out rows of one label only: the score cannot rise, so training ends after two more epochs and keeps the first one."""
    df = rows(spark).where("split = 'train' or label = 'a'")
    labels = R.prepare(df, str(tmp_path / "m"), "id", "split", features=256)
    run = R.fit(spark, str(tmp_path / "m"), labels, epochs=20, steps=1, patience=2, features=256)
    assert len(run.history) == run.best + 3 < 20
    assert R.fit(spark, str(tmp_path / "m"), labels, epochs=20, steps=1, patience=2, features=256).history == run.history


def test_workers_expand_few_rows_at_a_time(spark, tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000))], names=["x"])
    parts = list(R.sliced(iter([batch, batch.slice(0, 3)])))
    assert max(p.num_rows for p in parts) <= 512 and [x for p in parts for x in p.column(0).to_pylist()] == [*range(10_000), 0, 1, 2]
    folder = str(tmp_path / "m")
    labels = R.prepare(rows(spark), folder, "id", "split", features=64)
    table = spark.read.parquet(f"{folder}/features")
    whole = R.gradient(table, np.zeros((65, len(labels))))
    R.ROWS, before = 7, R.ROWS
    try:
        some = R.gradient(table, np.zeros((65, len(labels))))
    finally:
        R.ROWS = before
    assert np.allclose(whole[0], some[0], atol=1e-7) and abs(whole[1] - some[1]) < 1e-7


def test_words_behind_the_first_128_count(spark, tmp_path):
    """Labels that only late words tell are learned, and a row's features are all its words by count and idf."""
    head = " ".join(["word"] * 300)
    df = rows(spark).where("id < 900 and id > 5").withColumn("text", F.concat(F.lit(head + " "), "text"))
    folder, features = str(tmp_path / "m"), 4096
    labels = R.prepare(df, folder, "id", "split", features=features)
    run = R.fit(spark, folder, labels, epochs=6, steps=2, patience=9, features=features)
    assert max(f for _, f in run.history) > 0.9

    places = df.select(F.xxhash64("id").alias("id"), "split", F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.pmod(F.xxhash64(w), F.lit(features))).alias("words")).collect()
    train = [set(r["words"]) for r in places if r["split"] == "train"]
    got = {r["id"]: dict(zip(r["idx"], r["val"], strict=True)) for r in spark.read.parquet(f"{folder}/features").collect()}
    assert len(got) == len(places)
    for r in places:
        v = {w: r["words"].count(w) * np.log((len(train) + 1) / (sum(w in t for t in train) + 1)) for w in set(r["words"])}
        norm = np.sqrt(sum(x * x for x in v.values()))
        assert got[r["id"]].keys() == v.keys() and all(abs(got[r["id"]][w] - x / norm) < 1e-5 for w, x in v.items())


def test_texts_without_words_have_no_features(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", "x", "train"), (2, None, "x", "train"), (3, "  ", "y", "train"), (4, "c", "y", "held"), (5, "", "x", "held")], "id long, text string, label string, split string")
    R.prepare(df, str(tmp_path / "m"), "id", "split")
    n = {r["id"]: len(r["idx"]) for r in spark.read.parquet(f"{tmp_path}/m/features").collect()}
    ids = [r["h"] for r in df.orderBy("id").select(F.xxhash64("id").alias("h")).collect()]
    assert [n[h] for h in ids] == [2, 0, 0, 1, 0]
