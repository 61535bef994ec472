"""Text similarity of pairs by matching blocks, an Arrow function: no built-in computes this ratio.

The measure is that of `difflib`: twice the characters in matching blocks by those of both texts. The longest common run of rare characters (all characters, if the
second text has fewer than 200; else those that make up at most a hundredth of it) is taken first, the earliest of equal ones, and widened by whatever characters agree on both sides;
what lies before and behind it is treated likewise. `difflib` looks at every pair of equal rare characters for each block. Here runs of two or more are found once
by their pairs of characters and only clipped for each block; where none is left, the next single character is looked up.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLAG_BELOW = 0.92
PAIRS = 1 << 20  # pairs of equal places held at a time, and those of one more place


def rare_places(a: str, b: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The rare characters of b, and at each place of a and b (and one behind) the number of the rare character there, 0 for others."""
    most = len(b) // 100 + 1 if len(b) >= 200 else len(b)
    rare = sorted(c for c in set(b) if b.count(c) <= most)
    codes = np.array([ord(c) for c in rare] + [1 << 30], np.int64)

    def number(text: str) -> np.ndarray:
        at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        k = np.searchsorted(codes, at)
        return np.append(np.where(codes[k] == at, k + 1, 0), 0)

    return rare, number(a), number(b)


def common_runs(ra: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """(place in a, place in b, length) of all common runs of two or more rare characters, three rows."""
    ia, jb = np.flatnonzero((ra[:-1] > 0) & (ra[1:] > 0)), np.flatnonzero((rb[:-1] > 0) & (rb[1:] > 0))
    base = int(max(ra.max(), rb.max())) + 1
    ga, gb = ra[ia] * base + ra[ia + 1], rb[jb] * base + rb[jb + 1]
    order = np.argsort(gb, kind="stable")
    low, high = np.searchsorted(gb[order], ga, "left"), np.searchsorted(gb[order], ga, "right")
    starts = [(ia[:0], jb[:0])]
    ends = np.append(0, np.cumsum(high - low))
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], PAIRS)), len(ia)))
    for at, to in zip(cuts[:-1], cuts[1:], strict=True):  # some pairs of places at a time: only starts of runs stay
        n = (high - low)[at:to]
        i = np.repeat(ia[at:to], n)
        j = jb[order][np.arange(len(i)) + np.repeat(low[at:to] - np.cumsum(n) + n, n)]
        first = (i == 0) | (j == 0) | (ra[i - 1] == 0) | (ra[i - 1] != rb[j - 1])
        starts.append((i[first], j[first]))
    i, j = (np.concatenate(x) for x in zip(*starts, strict=True))
    size = np.full(len(i), 2)
    open_ = np.arange(len(i))
    while len(open_):
        x, y = ra[i[open_] + size[open_]], rb[j[open_] + size[open_]]
        open_ = open_[(x > 0) & (x == y)]
        size[open_] += 1
    return np.stack([i, j, size])


def matched(a: str, b: str) -> int:
    """The number of characters in matching blocks."""
    rare, ra, rb = rare_places(a, b)
    runs = common_runs(ra, rb)
    in_a = np.flatnonzero(ra).tolist()
    in_b: dict[str, list[int]] = {c: [] for c in rare}
    for j in np.flatnonzero(rb).tolist():
        in_b[b[j]].append(j)
    total = 0
    todo = [(0, len(a), 0, len(b), runs, True)]  # a's and b's range, runs that reach into it, whether rare characters may agree there
    while todo:
        a0, a1, b0, b1, runs, some = todo.pop()
        i, j, size = a0, b0, 0
        if runs.shape[1]:
            cut = np.maximum(np.maximum(a0 - runs[0], b0 - runs[1]), 0)
            left = np.minimum(np.minimum(a1 - runs[0], b1 - runs[1]), runs[2]) - cut
            size = int(left.max())
            if size >= 2:
                best = np.flatnonzero(left == size)
                i, j = min(zip((runs[0] + cut)[best].tolist(), (runs[1] + cut)[best].tolist(), strict=True))
                runs = runs[:, left >= 2]
            else:
                size, runs = 0, runs[:, :0]
        alone = some and not size
        if alone:
            for k in range(bisect_left(in_a, a0), len(in_a)):
                if in_a[k] >= a1:
                    break
                places = in_b[a[in_a[k]]]
                at = bisect_left(places, b0)
                if at < len(places) and places[at] < b1:
                    i, j, size = in_a[k], places[at], 1
                    break
        more = size > 0
        while i > a0 and j > b0 and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < a1 and j + size < b1 and a[i + size] == b[j + size]:
            size += 1
        total += size
        if size and i > a0 and j > b0:
            todo.append((a0, i, b0, j, runs, more and not alone))
        if size and i + size < a1 and j + size < b1:
            todo.append((i + size, a1, j + size, b1, runs, more))
    return total


def similar(a: str, b: str) -> float:
    if a == b or not a or not b:
        return float(a == b)
    return round(2.0 * matched(a, b) / (len(a) + len(b)), 4)


@F.pandas_udf(T.DoubleType())
def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([similar(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def compare(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with similarity and abnormal; all normalised characters of both texts count."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\s+", " "))
    return pairs.withColumn("similarity", ratio(norm(a), norm(b))).withColumn("abnormal", F.col("similarity") < FLAG_BELOW)
