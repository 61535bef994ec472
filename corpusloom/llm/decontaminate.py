"""Benchmark decontamination: n-gram seeds, rare ones first, then Smith-Waterman alignment.

1. The benchmark's words get ids; its n-grams of `n` words (fewer for shorter items) are hashed. Benchmarks are handled in blocks
   of at most `BLOCK_BYTES` of text, one after the other, so what is broadcast has a fixed bound however large they are.
2. One pass over all documents finds every benchmark n-gram and keeps, for documents with a hit, the places and the word ids
   around them (words that no item has become -1, which matches nothing). Texts are read once and never shuffled.
3. Document frequencies of the n-grams over the whole corpus decide which of them seed first: those in at most `rare` of the
   documents, and in every stretch of `stretch` neighbouring n-grams of an item the rarest one that occurs.
4. Around all n-grams that a document and an item share, they are aligned word by word (match 1, mismatch and gap -1): first the
   windows with a rare seed, then all others that could score more yet. A window is left out only if the words that it has in
   common with the item are too few for the threshold or for more than the best so far, so no copy is lost, however many
   documents hold it and however it is edited, as long as `n` words in a row are left. The score is the best local
   alignment's over the item's length; 1 is a whole exact copy. n_seeds counts the diagonals of the shared n-grams.

Frequencies are one row per benchmark n-gram, so their size is bound by the benchmark block, not by the corpus.

A block costs one pass over the documents, so a benchmark of B bytes costs B / `BLOCK_BYTES` passes.

Edge cases: null or wordless texts and items match nothing; an item of fewer than `n` words says too little in running text and
matches only texts that have its words and no others; items and documents whose id is null take part and are reported with it;
repeated rows each give their rows; items with equal texts are each reported; an empty table gives an empty result; extra
columns are ignored. A text of any length is searched whole; windows that seeds leave far apart are aligned apart and the
best counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_rows, materialize, received, shipped, table, trimmed

N, STRETCH, RARE, THRESHOLD = 4, 4, 1e-4, 0.5
BLOCK_BYTES = 16 << 20
CELLS = 1 << 20
WORD = re.compile(r"\w+")
MULT = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive ids; 0 where one of them is -1."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    u = (ids + 2).astype(np.uint64)
    h = np.zeros(len(ids) - n + 1, np.uint64)
    ok = np.ones(len(h), bool)
    for k in range(n):
        part = slice(k, k + len(h))
        h = (h ^ u[part]) * MULT
        h ^= h >> np.uint64(29)
        ok &= ids[part] >= 0
    return np.where(ok, h | np.uint64(1), np.uint64(0))


class Items:
    """A block of benchmark items: vocabulary, word ids and n-grams."""

    def __init__(self, rows: list[tuple[int | None, str]], n: int = N):
        self.n = n
        self.vocab: dict[str, int] = {}
        self.ids, self.tokens, self.sizes = [], [], []
        for item, text in rows:
            t = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words(text)], np.int64)
            if len(t):
                self.ids.append(item)
                self.tokens.append(t)
                self.sizes.append(min(n, len(t)))
        self.longest = max(map(len, self.tokens), default=0)
        grams: dict[int, dict[int, int]] = {}
        self.grams = []  # for each item the numbers of its n-grams in order
        count = 0
        for t, size in zip(self.tokens, self.sizes, strict=True):
            of = grams.setdefault(size, {})
            own = []
            for h in gram_hashes(t, size).tolist():
                if h not in of:
                    of[h] = count
                    count += 1
                own.append(of[h])
            self.grams.append(own)
        self.n_grams = count
        flat = np.array([g for own in self.grams for g in own], np.int64)
        self.order = np.argsort(flat, kind="stable")  # places of n-grams in items by n-gram: those of n-gram g are first[g] to first[g + 1]
        self.first = np.searchsorted(flat[self.order], np.arange(count + 1))
        lengths = [len(own) for own in self.grams]
        self.of_item = np.repeat(np.arange(len(lengths)), lengths)[self.order]
        self.offset = np.array([o for n_own in lengths for o in range(n_own)], np.int64)[self.order]
        self.counts = [np.unique(t, return_counts=True) for t in self.tokens]
        self.lookup = {size: (np.array(sorted(of), np.uint64), np.array([of[h] for h in sorted(of)], np.int64)) for size, of in grams.items()}


def item_blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most `most` bytes of text (one item at least)."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        more = len(row["text"].encode("utf-8", "replace"))
        if held and size + more > most:
            yield held
            held, size = [], 0
        held.append((row["item_id"], row["text"]))
        size += more
    if held:
        yield held


def hits(docs: DataFrame, items) -> DataFrame:
    """(doc_id, grams, places, starts, ends, ids): n-gram numbers and word places; ids holds the words of the stretches [start, end) around them."""

    def start():
        it = received(items)
        get, margin = it.vocab.get, 2 * it.longest + 8

        def find(texts: list[str | None]):
            rows, out = [], []
            for row, text in enumerate(texts):
                if not text:
                    continue
                toks = WORD.findall(text.lower())
                ids = np.fromiter(map(get, toks, repeat(-1)), np.int64, len(toks))
                found = []
                for size, (hashes, numbers) in it.lookup.items():
                    if size < it.n and len(ids) != size:
                        continue
                    h = gram_hashes(ids, size)
                    at = np.flatnonzero(h)
                    if len(at):
                        k = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
                        same = hashes[k] == h[at]
                        found.append((numbers[k[same]], at[same]))
                if not found:
                    continue
                grams, places = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                if not len(places):
                    continue
                order = np.argsort(places, kind="stable")
                grams, places = grams[order], places[order]
                cut = np.flatnonzero(np.diff(places) > 2 * margin) + 1
                starts = np.maximum(places[np.r_[0, cut]] - margin, 0)
                ends = np.minimum(places[np.r_[cut - 1, len(places) - 1]] + margin, len(ids))
                parts = np.concatenate([ids[a:b] for a, b in zip(starts, ends, strict=True)])
                rows.append(row)
                out.append([x.astype("<i4").tobytes() for x in (grams, places, starts, ends, parts)])
            return rows, list(zip(*out, strict=True)) or [[]] * 5

        return find

    return map_rows(docs, ["doc_id"], ["text"], "grams binary, places binary, starts binary, ends binary, ids binary", start)


def frequencies(found: DataFrame, n_grams: int) -> np.ndarray:
    """Documents that hold each n-gram; counted in each task, then added up: one row for each n-gram and task leaves a task."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(n_grams, np.int64)
        for batch in batches:
            for g in batch["grams"]:
                own[np.unique(np.frombuffer(g, "<i4"))] += 1
        seen = np.flatnonzero(own)
        yield pd.DataFrame({"gram": seen, "n": own[seen]})

    out = np.zeros(n_grams, np.int64)
    for row in found.select("grams").mapInPandas(trimmed(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["gram"]] = row["n"]
    return out


def seeds(items: Items, df: np.ndarray, n_docs: int, rare: float = RARE, stretch: int = STRETCH) -> np.ndarray:
    """Which places of n-grams in items, in the order of `Items.first`, seed first."""
    out = []
    for own in items.grams:
        f = df[own]
        keep = (f > 0) & (f <= max(1.0, rare * n_docs))
        occurs = np.where(f > 0, f, np.iinfo(np.int64).max)
        for a in range(max(1, len(own) - stretch + 1)):
            keep[a + int(np.argmin(occurs[a : a + stretch]))] = True
        out.append(keep)
    return np.concatenate(out)[items.order]


def shared_words(window: np.ndarray, item: int, items: Items) -> int:
    """Words that window and item have in common, each as often as both have it: no alignment scores more."""
    own, counts = items.counts[item]
    k = np.minimum(np.searchsorted(own, window), len(own) - 1)
    return int(np.minimum(np.bincount(k[own[k] == window], minlength=len(own)), counts).sum())


def windows(row, items: Items, seeding: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool, int]]:
    """(item, word ids, whether a rare n-gram seeds it, diagonals) of the windows around all n-grams that a document and an item share."""
    grams, places, starts, ends, ids = (np.frombuffer(x, "<i4").astype(np.int64) for x in row)
    base = np.r_[0, np.cumsum(ends - starts)]
    n = items.first[grams + 1] - items.first[grams]
    at = np.repeat(items.first[grams] - np.cumsum(n) + n, n) + np.arange(n.sum())
    item, line, rare = items.of_item[at], np.repeat(places, n) - items.offset[at], seeding[at]
    order = np.lexsort((line, item))
    item, line, rare = item[order], line[order], rare[order]
    size = np.array([len(t) for t in items.tokens])[item]
    slack = size // 2 + 2
    cut = np.flatnonzero((np.diff(item) != 0) | (np.diff(line) > (size + 2 * slack)[1:])) + 1
    for u, v in zip(np.r_[0, cut].tolist(), np.r_[cut, len(item)].tolist(), strict=True):
        s = max(0, int(np.searchsorted(starts, max(int(line[u]), 0), "right")) - 1)
        a, b = max(int(line[u] - slack[u]), int(starts[s])), min(int(line[v - 1] + size[u] + slack[u]), int(ends[s]))
        if b > a:
            yield int(item[u]), ids[base[s] + a - starts[s] : base[s] + b - starts[s]], bool(rare[u:v].any()), len(np.unique(line[u:v]))


def align(window: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Best Smith-Waterman scores of rows of windows [b, w] against rows of items [b, l]; -2 pads items, -1 matches nothing."""
    b, w = window.shape
    place = np.arange(1, w + 1, dtype=np.int32)
    before = np.zeros((b, w + 1), np.int32)
    best = np.zeros(b, np.int32)
    for i in range(item.shape[1]):
        same = np.where(window == item[:, i : i + 1], 1, -1).astype(np.int32)
        now = np.maximum(np.maximum(before[:, :-1] + same, before[:, 1:] - 1), 0)
        # A gap in the item: the running maximum of score + place, less the place.
        now = np.maximum.accumulate(now + place, axis=1) - place
        before[:, 1:] = now
        np.maximum(best, now.max(axis=1), out=best)
    return best


def score_pairs(jobs: list[tuple[int, int, np.ndarray]], items: Items) -> list[int]:
    """Alignment scores of (owner, item, window) jobs, equal ones once, in padded batches of like lengths."""
    first: dict[tuple[int, bytes], int] = {}
    which = [first.setdefault((i, w.tobytes()), k) for k, (_, i, w) in enumerate(jobs)]
    todo = sorted(set(which), key=lambda k: (len(items.tokens[jobs[k][1]]), len(jobs[k][2])))
    scores: dict[int, int] = {}
    a = 0
    while a < len(todo):
        part, widest = [], 0
        while a < len(todo) and len(part) < 256:  # a batch of few cells, or one job
            widest = max(widest, len(jobs[todo[a]][2]))
            if part and widest * (len(part) + 1) > CELLS:
                break
            part.append(todo[a])
            a += 1
        win = np.full((len(part), max(len(jobs[k][2]) for k in part)), -1, np.int64)
        item = np.full((len(part), max(len(items.tokens[jobs[k][1]]) for k in part)), -2, np.int64)
        for r, k in enumerate(part):
            win[r, : len(jobs[k][2])] = jobs[k][2]
            item[r, : len(items.tokens[jobs[k][1]])] = items.tokens[jobs[k][1]]
        for k, s in zip(part, align(win, item).tolist(), strict=True):
            scores[k] = s
    return [scores[k] for k in which]


def aligned(found: DataFrame, items, seeding, threshold: float) -> DataFrame:
    def start():
        it, first = received(items), received(seeding)

        def score(*columns):
            jobs: dict[bool, list[tuple[int, int, np.ndarray, int]]] = {True: [], False: []}
            seen: dict[tuple[int, int], int] = {}
            for r, row in enumerate(zip(*columns, strict=True)):
                for i, window, rare, n in windows(row, it, first):
                    seen[r, i] = seen.get((r, i), 0) + n
                    most = shared_words(window, i, it)
                    if most >= threshold * len(it.tokens[i]):
                        jobs[rare].append((r, i, window, most))
            best: dict[tuple[int, int], int] = {}
            for rare in (True, False):
                todo = [(r, i, window) for r, i, window, most in jobs[rare] if most > best.get((r, i), -1)]
                for (r, i, _), s in zip(todo, score_pairs(todo, it), strict=True):
                    best[r, i] = max(best.get((r, i), 0), s)
            kept = [(r, i, s / len(it.tokens[i])) for (r, i), s in best.items() if s >= threshold * len(it.tokens[i])]
            return [r for r, _, _ in kept], [[it.ids[i] for _, i, _ in kept], [s for _, _, s in kept], [seen[r, i] for r, i, _ in kept]]

        return score

    return map_rows(found, ["doc_id"], ["grams", "places", "starts", "ends", "ids"], "item_id long, score double, n_seeds int", start)


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, rare: float = RARE, stretch: int = STRETCH, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, n_seeds): a row for each document and benchmark item whose alignment scores threshold or more."""
    spark = docs.sparkSession
    out = None
    n_docs = docs.count()
    for rows in item_blocks(benchmark):
        block = Items(rows, n)
        if not block.ids:
            continue
        items = shipped(spark, block)
        found = materialize(hits(docs, items), "hits")
        seeding = shipped(spark, seeds(block, frequencies(found, block.n_grams), n_docs, rare, stretch))
        part = aligned(found, items, seeding, threshold)
        out = part if out is None else out.unionByName(part)
    if out is None:
        kinds = spark.createDataFrame([], "item_id long, score double, n_seeds int").schema
        return spark.createDataFrame([], StructType([docs.schema["doc_id"], *kinds.fields]))
    return out


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
