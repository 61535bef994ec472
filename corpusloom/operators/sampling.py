"""Stratified quotas, samples and splits. Samples are ordered by a hash, so they repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def strata(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


class Quotas:
    """Greedy allocation over a few hundred strata. Strata are taken in sorted order, so that the result repeats."""

    def __init__(self, counts: dict[tuple, int]):
        self.counts = {k: counts[k] for k in sorted(counts) if counts[k] > 0}
        self.given = dict.fromkeys(self.counts, 1)

    def room(self, k: tuple) -> int:
        return self.counts[k] - self.given[k]

    def total(self, axis: int | None = None, value=None) -> int:
        return sum(n for k, n in self.given.items() if axis is None or k[axis] == value)

    def spread(self, keys: list[tuple], need: int) -> int:
        """Share `need` among keys in proportion to their room (half-even), one at least; returns what is still needed."""
        room = {k: self.room(k) for k in keys if self.room(k) > 0}
        all_room = sum(room.values())
        need_at_first = need
        for k, r in room.items():
            if need <= 0:
                break
            share = min(max(1, round(need_at_first * r / all_room)), r, need)
            self.given[k] += share
            need -= share
        return need

    def raise_to(self, axis: int, value, least: int) -> None:
        """First one more for each stratum of the value in turn, then the rest in proportion."""
        need = least - self.total(axis, value)
        keys = [k for k in self.counts if k[axis] == value and self.room(k) > 0]
        for k in keys:
            if need <= 0:
                return
            self.given[k] += 1
            need -= 1
        if need > 0:
            self.spread(keys, need)

    def settle(self, total: int) -> None:
        """Reach the total exactly: in proportion, then one by one to the smallest quota; or down from the largest, not below one."""
        need = total - self.total()
        if need > 0:
            need = self.spread(list(self.counts), need)
            while need > 0 and (open_ := [k for k in self.counts if self.room(k) > 0]):
                self.given[min(open_, key=self.given.get)] += 1
                need -= 1
        while need < 0 and (large := [k for k in self.counts if self.given[k] > 1]):
            self.given[max(large, key=self.given.get)] -= 1
            need += 1


def allocate(counts: dict[tuple, int], total: int = 400, stance_min: int = 120, year_min: int = 5, source_min: int = 10, core_from: int = 10) -> dict[tuple, int]:
    """Quotas of (stance, year, source) strata: one each; every year its minimum; every stance; every core source; then the total."""
    q = Quotas(counts)
    for y in sorted({k[1] for k in q.counts}):
        q.raise_to(1, y, year_min)
    for s in sorted({k[0] for k in q.counts}):
        q.raise_to(0, s, stance_min)
    for src in sorted({k[2] for k in q.counts}):
        if sum(n for k, n in q.counts.items() if k[2] == src) >= core_from:
            q.raise_to(2, src, source_min)
    q.settle(total)
    return q.given


def quota_table(spark: SparkSession, df: DataFrame, keys: list[str], **limits) -> DataFrame:
    """(keys, n, quota): the strata counts come to the driver (a row a stratum), the rows do not."""
    counts = {tuple(r[k] for k in keys): r["n"] for r in strata(df.na.drop(subset=keys), keys).collect()}
    given = allocate(counts, **limits)
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return spark.createDataFrame([(*k, counts[k], n) for k, n in given.items()], f"{kinds}, n long, quota int")


def hash_order(id_col: str, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def draw(df: DataFrame, quotas: DataFrame, keys: list[str], id_col: str, seed: int = 42) -> DataFrame:
    """The first `quota` rows of every stratum in hash order."""
    within = Window.partitionBy(*keys).orderBy(hash_order(id_col, seed), id_col)
    return df.withColumn("_n", F.row_number().over(within)).join(F.broadcast(quotas.select(*keys, "quota")), keys).where("_n <= quota").drop("_n", "quota")


def blind(sample: DataFrame, order: list[str], hide: list[str]) -> DataFrame:
    """Numbered rows without the hidden columns and with an empty one for the annotator."""
    n = F.row_number().over(Window.orderBy(*order))
    return sample.withColumn("sample_id", F.format_string("S%04d", n)).drop(*hide).withColumn("human_stance", F.lit(""))


def split(df: DataFrame, keys: list[str], id_col: str, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """df with split train, val or test: every stratum is cut at the ratios in hash order; strata of one row train."""
    if abs(sum(ratios) - 1) > 0.001:
        raise ValueError("ratios must sum to 1")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(hash_order(id_col, seed), id_col))
    d = df.withColumn("_n", n).withColumn("_i", i)
    train, val = F.greatest(F.floor(F.col("_n") * ratios[0] + 0.5), F.lit(1)), F.floor(F.col("_n") * (ratios[0] + ratios[1]) + 0.5)
    return d.withColumn("split", F.when(F.col("_i") <= train, "train").when(F.col("_i") <= val, "val").otherwise("test")).drop("_n", "_i")
