"""Exact top-k inner product search over a bit-sliced index.

Index: vectors are quantised to integers; every input partition packs its rows, in blocks of at most `BLOCK` rows ordered by
vec_id, into bit slices (one bitmap over the block's rows for each bit of each component, offset by the block's
smallest value). No shuffle is needed, and blocks are even whatever the data.

Search: for a query, component d adds |q_d| times its slices (or their complements where q_d is negative, with a constant
to make up), bit by bit through carry-save adders on bitmaps, which leaves the slices of the score. The top rows are then
chosen from the most significant slice downward; rows that tie at the boundary are told apart exactly, by vec_id, which
is the bit order. Index blocks are dealt to parts once and every part gets a copy of the query blocks, so the shuffle grows with
the index and the queries, not with their product; each block pair returns k rows, and a window keeps the k best of each query.

Edge cases: null vectors and vectors with null or non-finite components take no part, nor do rows without vec_id; a query
meets only vectors of its own length; rows with the query's vec_id are its own; equal vectors tie and go by vec_id;
an empty table gives an empty result; extra columns are ignored. A component so large that a score could pass 64 bits (above
2**31 / sqrt(dimensions) after scaling) stops the job with a message, as no right score could be given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, table, trimmed

BLOCK, QUERY_BLOCK = 16_384, 256
INDEX_SCHEMA = "block long, dim int, n int, bits int, ids binary, low binary, slices binary"


def quantise(vectors: DataFrame, scale: float = 1024.0) -> DataFrame:
    """(vec_id, q): floor(scale * x) of each component; rows that take no part are left out."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    kept = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & finite)
    most = F.sqrt(F.lit(float(1 << 62)) / F.size(e))
    large = F.exists(e, lambda x: F.abs(x.cast("double") * F.lit(scale)) >= most)
    q = F.transform(e, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))
    return kept.select("vec_id", F.when(large, F.raise_error(F.lit("a component is too large for 64-bit scores"))).otherwise(q).alias("q"))


def pack(ids: np.ndarray, q: np.ndarray) -> dict:
    """One index block of rows ordered by id: slices[d, b] is the bitmap of bit b of component d above low[d]."""
    n, dim = q.shape
    low = q.min(axis=0)
    u = (q - low).astype(np.uint64)
    bits = max(1, int(u.max()).bit_length())
    words = -(-n // 64)
    out = np.zeros((dim, bits, words * 8), np.uint8)
    for b in range(bits):
        out[:, b, : -(-n // 8)] = np.packbits(((u >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little")
    return {"dim": dim, "n": n, "bits": bits, "ids": ids.astype("<i8").tobytes(), "low": low.astype("<i8").tobytes(), "slices": out.tobytes()}


def build_index(quantised: DataFrame, block: int = BLOCK) -> DataFrame:
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << 33, 0
        held: dict[int, list] = {}

        def emit(dim: int) -> pd.DataFrame:
            nonlocal made
            rows = held.pop(dim)
            ids, q = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
            order = np.argsort(ids, kind="stable")
            made += 1
            return pd.DataFrame([{"block": first + made, **pack(ids[order], q[order])}])

        for batch in batches:
            for i, q in zip(batch["vec_id"], batch["q"], strict=True):
                held.setdefault(len(q), []).append((i, q))
                if len(held[len(q)]) >= block:
                    yield emit(len(q))
        for dim in list(held):
            yield emit(dim)

    return quantised.mapInPandas(trimmed(packed), INDEX_SCHEMA)


def score_slices(slices: np.ndarray, q: np.ndarray) -> tuple[list[np.ndarray], int]:
    """(slices of sum |q_d| * (u_d or its complement), least significant first; the constant that q . u is above it)."""
    dim, bits, words = slices.shape
    flat = slices.reshape(dim * bits, words)
    size, negative = np.abs(q), q < 0
    both = np.concatenate([flat, ~flat]) if negative.any() else flat
    constant = -int(size[negative].sum()) * ((1 << bits) - 1)
    width = max(1, int(size.max()).bit_length())
    d, j = np.nonzero((size[:, None] >> np.arange(width)) & 1)
    place = (j[:, None] + np.arange(bits)).ravel()
    row = ((d + negative[d] * dim)[:, None] * bits + np.arange(bits)).ravel()
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    ends = np.searchsorted(place, np.arange(width + bits + 1))
    out, carries, w = [], [], 0
    while w < width + bits or carries:
        rows = [both[row[ends[w] : ends[w + 1]]]] if w < width + bits - 1 else []
        now = np.concatenate(rows + carries) if rows or carries else np.zeros((0, words), np.uint64)
        carries = []
        while len(now) > 2:
            t = len(now) // 3
            a, b, c = now[:t], now[t : 2 * t], now[2 * t : 3 * t]
            x = a ^ b
            carries.append((a & b) | (x & c))
            now = np.concatenate([x ^ c, now[3 * t :]])
        if len(now) == 2:
            carries.append(now[:1] & now[1:])
            now = now[:1] ^ now[1:]
        out.append(now[0] if len(now) else np.zeros(words, np.uint64))
        w += 1
    return out, constant


def first_rows(bitmap: np.ndarray, k: int) -> np.ndarray:
    """The first k rows of a bitmap."""
    full = np.flatnonzero(bitmap)[:k]
    bits = np.unpackbits(bitmap[full].view(np.uint8), bitorder="little").reshape(len(full), 64)
    w, b = np.nonzero(bits)
    return (full[w] * 64 + b)[:k]


def top_rows(score: list[np.ndarray], rows: np.ndarray, k: int) -> np.ndarray:
    """The k rows of highest score among the bitmap rows, ties to the first: from the most significant slice downward."""
    sure, open_ = np.zeros_like(rows), rows
    for s in reversed(score):
        hit = open_ & s
        n = int(np.bitwise_count(sure | hit).sum())
        if n > k:
            open_ = hit
        else:
            sure = sure | hit
            open_ = open_ & ~s
            if n == k:
                open_ = np.zeros_like(rows)
                break
    n = int(np.bitwise_count(sure).sum())
    return np.concatenate([first_rows(sure, n), first_rows(open_, k - n)]).astype(np.int64)


def search_block(block, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list, list, list]:
    n, words = block.n, -(-block.n // 64)
    slices = np.frombuffer(block.slices, "<u8").reshape(block.dim, block.bits, words)
    own, low = np.frombuffer(block.ids, "<i8"), np.frombuffer(block.low, "<i8")
    there = np.zeros(words * 64, bool)
    there[:n] = True
    everything = np.packbits(there, bitorder="little").view("<u8")
    out: tuple[list, list, list] = ([], [], [])
    for i, q in zip(ids, queries, strict=True):
        rows = everything
        a, b = np.searchsorted(own, [i, i + 1])
        if a < b:
            mask = there.copy()
            mask[a:b] = False
            rows = np.packbits(mask, bitorder="little").view("<u8")
        if not q.any():
            score, constant = [], 0
        else:
            score, constant = score_slices(slices, q)
        best = top_rows(score, rows, k)
        total = np.full(len(best), constant + int(q @ low), np.int64)
        for w, s in enumerate(score):
            total += ((s[best // 64] >> (best % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << w
        out[0].append(np.full(len(best), i))
        out[1].append(own[best])
        out[2].append(total)
    return out


def search(index: DataFrame, queries: DataFrame, k: int = 10, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best index rows for each query (vec_id, q)."""
    spark = index.sparkSession
    n_blocks = max(1, -(-queries.count() // query_block))

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        rows: dict[int, list] = {}
        for batch in batches:
            for i, q in zip(batch["vec_id"], batch["q"], strict=True):
                rows.setdefault(len(q), []).append((i, q))
        for dim, held in rows.items():
            yield pd.DataFrame([{"qb": TaskContext.get().partitionId(), "q_dim": dim, "q_ids": np.array([r[0] for r in held], "<i8").tobytes(), "qs": np.array([r[1] for r in held], "<i8").tobytes()}])

    blocks = materialize(queries.repartition(n_blocks).mapInPandas(trimmed(gathered), "qb int, q_dim int, q_ids binary, qs binary"), "queries")
    # The index is dealt to `deal` parts and every part gets a copy of the query blocks. An index of fewer blocks than there are tasks
    # is copied to `copies` sets of parts, each with its own share of the queries: at most as many blocks as there are tasks. A join key
    # holds one part's index blocks and its query blocks, which spill beyond 4096 rows.
    tasks, n_index = shuffle_partitions(spark), max(1, index.count())
    deal, copies = min(tasks, n_index), max(1, tasks // n_index)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = index.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(deal))).withColumn("share", each(copies))
    right = blocks.withColumn("share", F.pmod(F.col("qb").cast("long"), F.lit(copies))).withColumn("part", each(deal))
    met = left.hint("merge").join(right, (left["part"] == right["part"]) & (left["share"] == right["share"]) & (left["dim"] == right["q_dim"]))
    pairs = met.select("dim", "n", "bits", "ids", "low", "slices", "q_ids", "qs")

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = np.frombuffer(row.q_ids, "<i8")
                found = search_block(row, ids, np.frombuffer(row.qs, "<i8").reshape(len(ids), row.dim), k)
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, found), strict=True)))

    local = pairs.mapInPandas(trimmed(searched), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantise(table(spark, sf_dir, "embeddings"))
    whole = rows.coalesce(max(1, -(-rows.count() // BLOCK)))
    index = materialize(build_index(whole), "bsi")
    return search(index, rows.where(F.col("vec_id") % 100 == 0))


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = len(embedding)),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
