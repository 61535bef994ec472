"""Training a text classifier epoch by epoch: macro-F1 on held-out rows after each, early stop, resume from the last stored epoch.

Rows are turned into weighted hashed words once and written; a step sums the softmax gradient of its rows within each partition in numpy, and Spark sums the partitions by
weight, so the driver sees one gradient (`features` x labels numbers, a parameter) and no rows. A step's rows are chosen by a hash of row and epoch. Partial
gradients are rounded to fixed point before they are summed, so sums do not depend on their order and a run that was resumed ends with the very numbers of one that
was not. After each epoch the weights, their momentum and the score lie below the folder, complete or not at all.

Early stop: the best epoch's weights are kept; training ends after `patience` epochs without a better macro-F1, over the labels of the training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .agreement import class_weights

FEATURES = 1 << 12
FIXED = float(1 << 30)
ROWS = 512  # rows that a worker expands at a time
FEATURE_SCHEMA = "split string, y int, weight double, idx array<int>, val array<float>"


@dataclass
class Run:
    labels: list[str]
    weights: np.ndarray  # features + 1 (the bias) by labels
    history: list[tuple[int, float]] = field(default_factory=list)  # (epoch, macro-F1)
    best: int = -1


def hashed_words(text, features: int = FEATURES):
    """The places of all words of a text, repeats included."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))


def prepare(rows: DataFrame, folder: str, key: str, split: str, text: str = "text", label: str = "label", features: int = FEATURES) -> list[str]:
    """Write the features of rows (key, split train or held, text, label) below folder; the labels of the training rows, in order. Rows of other labels or splits go."""
    train = rows.where(F.col(split) == "train")
    weights = class_weights(train.select(F.col(label).cast("string").alias("label")), "label").where("label is not null")
    labels = sorted(r["label"] for r in weights.select("label").collect())  # one row a class
    known = rows.where(F.col(split).isin("train", "held")).select(F.xxhash64(key).alias("id"), F.col(split).alias("split"), F.col(label).cast("string").alias("label"), hashed_words(F.col(text), features).alias("words"))
    known = known.join(F.broadcast(weights.select("label", "weight")), "label")
    n_train = train.count()
    n_docs = train.select(F.explode(F.array_distinct(hashed_words(F.col(text), features))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    idf = {r["w"]: float(np.log((n_train + 1) / (r["n"] + 1))) for r in n_docs.collect()}  # at most `features` rows
    y = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")) - 1
    table = np.array([idf.get(k, float(np.log(n_train + 1))) for k in range(features)], np.float32)

    def weigh(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in sliced(batches):
            words, rows = batch.column(4), batch.num_rows
            row = np.repeat(np.arange(rows), words.value_lengths().to_numpy())
            at, n = np.unique(row * features + words.flatten().to_numpy(), return_counts=True)
            row, at = at // features, at % features
            v = n * table[at].astype(np.float64)
            norm = np.sqrt(np.bincount(row, v * v, minlength=rows))
            v /= np.where(norm > 0, norm, 1.0)[row]
            ends = pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (at.astype(np.int32), v.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(4)], *lists], names=["id", "split", "y", "weight", "idx", "val"])

    made = known.select("id", "split", y.cast("int").alias("y"), "weight", "words").mapInArrow(weigh, "id long, " + FEATURE_SCHEMA)
    made.write.mode("overwrite").parquet(f"{folder}/features")
    return labels


def sliced(batches: Iterator) -> Iterator:
    """The rows of batches, ROWS at a time, so that what a worker makes of them does not grow with the batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def dense(batch, features: int):
    """(rows, places, values) of a batch's sparse rows, the bias included, and their number."""
    size = batch.column("idx").value_lengths().to_numpy()
    row = np.concatenate([np.repeat(np.arange(len(size)), size), np.arange(len(size))])
    place = np.concatenate([batch.column("idx").flatten().to_numpy(), np.full(len(size), features)])
    return row, place, np.concatenate([batch.column("val").flatten().to_numpy().astype(np.float64), np.ones(len(size))]), len(size)


def scores(batch, weights: np.ndarray) -> np.ndarray:
    row, place, value, n = dense(batch, len(weights) - 1)
    out = np.zeros((n, weights.shape[1]))
    np.add.at(out, row, value[:, None] * weights[place])
    return out


def gradient(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """(sum of weighted gradients, sum of row weights) over rows, in fixed point until the end."""
    shape, total_size = weights.shape, weights.size + 1

    def part(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, mass = np.zeros(shape), 0.0
        for batch in sliced(batches):
            z = scores(batch, weights)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(p)), batch.column("y").to_numpy()] -= 1.0
            w = batch.column("weight").to_numpy()
            row, place, value, _ = dense(batch, shape[0] - 1)
            np.add.at(total, place, value[:, None] * (p * w[:, None])[row])
            mass += float(w.sum())
        flat = np.rint(np.append(total.ravel(), mass) * FIXED).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["k", "g"])

    sums = rows.select("y", "weight", "idx", "val").mapInArrow(part, "k int, g long").groupBy("k").agg(F.sum("g").alias("g")).toArrow()  # one row a weight
    flat = np.zeros(total_size)
    flat[sums.column("k").to_numpy()] = sums.column("g").to_numpy() / FIXED
    return flat[:-1].reshape(shape), float(flat[-1])


def macro_f1(rows: DataFrame, weights: np.ndarray) -> float:
    """Mean F1 of all labels; a label without rows and guesses counts 0."""

    def guess(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(scores(batch, weights).argmax(axis=1).astype(np.int32))], names=["y", "guess"])

    n = rows.select("y", "weight", "idx", "val").mapInArrow(guess, "y int, guess int").groupBy("y", "guess").agg(F.count(F.lit(1)).alias("n"))
    table = np.zeros((weights.shape[1], weights.shape[1]))
    for r in n.collect():  # one row a pair of labels
        table[r["y"], r["guess"]] = r["n"]
    right, both = np.diag(table), table.sum(axis=0) + table.sum(axis=1)
    return float(np.mean(np.divide(2 * right, both, out=np.zeros(len(right)), where=both > 0)))


def fit(spark: SparkSession, folder: str, labels: list[str], epochs: int = 8, steps: int = 4, patience: int = 2, rate: float = 4.0, momentum: float = 0.9, decay: float = 1e-5, features: int = FEATURES) -> Run:
    """Train on the features below folder, from its last stored epoch on. Call again with more epochs to go on."""
    rows = spark.read.parquet(f"{folder}/features")
    shape = (features + 1, len(labels))
    try:
        stored = spark.read.schema("epoch int, f1 double, weights array<double>, velocity array<double>").parquet(f"{folder}/epochs")
        past = sorted((r["epoch"], r["f1"]) for r in stored.select("epoch", "f1").collect())
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        past = []
    if not labels:
        return Run(labels, np.zeros(shape))

    def load(epoch: int) -> tuple[np.ndarray, np.ndarray]:
        r = spark.read.parquet(f"{folder}/epochs").where(F.col("epoch") == epoch).first()
        return np.array(r["weights"]).reshape(shape), np.array(r["velocity"]).reshape(shape)

    weights, velocity = load(past[-1][0]) if past else (np.zeros(shape), np.zeros(shape))
    train, held = rows.where("split = 'train'"), rows.where("split = 'held'")

    def best(history: list[tuple[int, float]]) -> int:
        return max(history, key=lambda h: (h[1], -h[0]))[0] if history else -1

    while len(past) < epochs and (not past or past[-1][0] - best(past) < patience):
        epoch = len(past)
        for step in range(steps):
            some = train.where(F.pmod(F.xxhash64("id", F.lit(epoch)), F.lit(steps)) == step)
            g, mass = gradient(some, weights)
            velocity = momentum * velocity - rate * (g / max(mass, 1e-9) + decay * weights)
            weights = weights + velocity
        f1 = macro_f1(held, weights)
        one = spark.createDataFrame([(epoch, f1, weights.ravel().tolist(), velocity.ravel().tolist())], "epoch int, f1 double, weights array<double>, velocity array<double>")
        one.coalesce(1).write.mode("append").parquet(f"{folder}/epochs")
        past.append((epoch, f1))
    chosen = best(past)
    return Run(labels, load(chosen)[0] if past else weights, past, chosen)
