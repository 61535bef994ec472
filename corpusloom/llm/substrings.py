"""Removal of repeated byte strings by suffix sorting in shards.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller doc_id. Strings are judged
on the input texts and never cross documents.

1. Equal texts are one text, that of the smallest doc_id; its other documents go whole (if they have `length` bytes).
2. Every string of `length` bytes is keyed by the smallest hash of its `GRAM`-byte substrings (winnowing), so equal strings have equal
   keys, and neighbouring strings mostly share one: a text has about 2 / (length - GRAM + 2) keys a byte. Keys are dealt out to
   shards; only those of two texts or more go on. A repeated string's key always does, so nothing is lost.
3. Stretches of text whose strings have such a key go to the key's shard, equal stretches of a batch of texts once, with the smallest
   doc_id they have there. A shard keeps each distinct stretch once and sorts their suffixes by external induced sorting:
   disk-backed priority queues of suffix tuples with their common prefixes, level by level (`suffixsort`). Neighbours whose common
   prefix has `length` bytes are one string, which takes the smallest doc_id of its stretches. A shard is sorted in parts by key, as
   equal strings have equal keys. (Not sorted is a stretch that is the only one of its key in all texts, or none of whose strings has
   its first and its last four fifths a second time in the part: no other stretch holds a string of it.)
4. What a shard finds of a stretch, runs of strings with their smallest doc_id, is joined to the places where the stretch stands by its
   128-bit hash. Only this join sees every place of a common stretch, and Spark splits it where one stretch has very many.
   The bytes that strings of a smaller doc_id cover are removed from each text.

Shards are numbered by hash, as many as there are shuffle partitions, which are to grow with the input; one is sorted at a time, in
`memory` bytes a structure and files beyond. Texts are shuffled once, into a table bucketed by their MD5 that later steps
read without a shuffle.

Edge cases: null is the empty text; a document without doc_id counts as larger than all others; rows with one doc_id do not
make each other repeated; texts shorter than `length` stay; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, materialize, shared_dir, shuffle_partitions, table, text_or_empty, trimmed
from .suffixsort import BLOCK, Space, sort

LENGTH, GRAM = 50, 24
MEMORY = 64 << 20
#: A shard is sorted in parts of `memory` / PART bytes, whose names, a third of them by number, then fit in memory.
PART = 40
LAST = (1 << 63) - 1
PLACES = "node string, low long, hs array<long>, ls array<long>, starts array<int>"
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class Keys:
    """Winnowing keys; powers of the rolling hash's base are kept."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        self.up = self.down = np.zeros(0, np.uint64)

    def grams(self, data: np.ndarray) -> np.ndarray:
        """The hash of the gram that starts at each byte."""
        n, g = len(data), self.gram
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = np.cumprod(np.full(size, BASE)), np.cumprod(np.full(size, INVERSE))
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
        h = (total[g:] - total[:-g]) * self.down[: n - g + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h

    def of(self, data: np.ndarray) -> np.ndarray:
        """The key of the string that starts at each byte (bytes -> keys of the len - length + 1 strings)."""
        if len(data) < self.length:
            return np.zeros(0, np.uint64)
        h = self.grams(data)
        want, have = self.length - self.gram + 1, 1
        while have * 2 <= want:
            h = np.minimum(h[:-have], h[have:])
            have *= 2
        if have < want:
            h = np.minimum(h[: len(h) - (want - have)], h[want - have :])
        # Smallest hashes crowd at the low end; spread them before shards are taken from their bits.
        h = h * BASE
        return h ^ (h >> np.uint64(31))

    def runs(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first string, end, key) of the maximal runs of strings with one key."""
        keys = self.of(data)
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), keys
        first = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1]
        return first, np.r_[first[1:], len(keys)], keys[first]


def parts(batches: Iterator[pd.DataFrame], most: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """The batches in parts of about `most` bytes of text."""
    for batch in batches:
        ends = np.cumsum([len(x) for x in batch["data"]])
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.iloc[at:end].reset_index(drop=True)
            at = end


def pack(*arrays) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, protocol=5), 1)


def unpack(blob: bytes):
    return pickle.loads(zstandard.decompress(blob))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(48)) * np.uint64(shards) >> np.uint64(16)).astype(np.int64)


def key_rows(texts: DataFrame, shards: int, length: int) -> DataFrame:
    """(shard, blob): for each batch of texts and shard the keys of each text that fall there."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = Keys(length)
        for batch in parts(batches):
            found = [np.unique(keys.runs(np.frombuffer(t, np.uint8))[2]) for t in batch["data"]]
            if not found:
                continue
            nodes = np.frombuffer(bytes.fromhex("".join(batch["node"])), np.uint8).reshape(-1, 16)
            all_, owner = np.concatenate(found), np.repeat(np.arange(len(found)), [len(f) for f in found])
            shard = shard_of(all_, shards)
            order = np.argsort(shard, kind="stable")
            all_, owner, shard = all_[order], owner[order], shard[order]
            ends = np.searchsorted(shard, np.arange(shards + 1))
            rows = []
            for s in range(shards):
                a, b = ends[s], ends[s + 1]
                if b > a:
                    docs, count = np.unique(owner[a:b], return_counts=True)
                    count = count.astype(np.min_scalar_type(int(count.max())))
                    rows.append((s, pickle.dumps((nodes[docs], count, all_[a:b].astype(np.uint32)), protocol=5)))
            if rows:
                yield pd.DataFrame(rows, columns=["shard", "blob"])

    return texts.select("node", "data").mapInPandas(trimmed(find), "shard int, blob binary")


def shared_keys(rows: DataFrame, shards: int) -> DataFrame:
    """(node, keys): the keys of each text that another text has too, low 32 bits, by shard. Keys that agree in these alone only bring
    stretches along that the sort finds to be no repeats."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for blobs in grouped(batches):
            parts = [pickle.loads(b) for b in blobs]
            nodes, counts, key = (np.concatenate([p[k] for p in parts]) for k in range(3))
            owner = np.repeat(np.arange(len(counts)), counts)
            order = np.argsort(key, kind="stable")
            k = key[order]
            twice = np.zeros(len(k), bool)
            twice[1:] = k[1:] == k[:-1]
            twice[:-1] |= twice[1:]
            use = np.sort(order[twice])
            own, kept = owner[use], key[use]
            cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
            ends = np.r_[cut[1:], len(own)][: len(cut)]
            if len(cut):
                yield pd.DataFrame({"node": [nodes[own[a]].tobytes().hex() for a in cut], "keys": [kept[a:b].tobytes() for a, b in zip(cut, ends, strict=True)]})

    return by_shard(rows, shards).mapInPandas(trimmed(count), "node string, keys binary")


def by_shard(rows: DataFrame, shards: int) -> DataFrame:
    return rows.repartition(shards, "shard").sortWithinPartitions("shard")


def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[Iterator[bytes]]:
    """The blobs of each shard, one shard after the other, as they are read."""
    rows = ((s, blob) for batch in batches for s, blob in zip(batch["shard"], batch["blob"], strict=True))
    for _, own in groupby(rows, lambda r: r[0]):
        yield (blob for _, blob in own)


def stretch_rows(texts: DataFrame, shared: DataFrame, shards: int, length: int) -> DataFrame:
    """Of each batch of texts (shard, blob): the stretches with a shared key, equal ones once, with their least and largest doc_id;
    and of each text (node, low, hs, ls, starts), under any shard: the 128-bit hashes of its stretches, and where they stand."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = Keys(length)
        for batch in parts(batches):
            stretch: dict[int, dict[bytes, list[int]]] = {}  # [key, least, largest doc_id] of each
            places = []
            for node, low, data, sets in zip(batch["node"], batch["low"].tolist(), batch["data"], batch["sets"], strict=True):
                wanted = np.frombuffer(b"".join(sets), np.uint32)
                first, end, key = keys.runs(np.frombuffer(data, np.uint8))
                use = np.flatnonzero(np.isin(key.astype(np.uint32), wanted))
                hashes = []
                for a, b, k, s in zip(first[use].tolist(), end[use].tolist(), key[use].view(np.int64).tolist(), shard_of(key[use], shards).tolist(), strict=True):
                    own = data[a : b + length - 1]
                    hashes.append(xxhash.xxh3_128_intdigest(own))
                    seen = stretch.setdefault(s, {}).setdefault(own, [k, low, low])
                    if low < seen[1]:
                        seen[1] = low
                    elif low > seen[2]:
                        seen[2] = low
                if hashes:
                    pair = np.frombuffer(b"".join(x.to_bytes(16, "little") for x in hashes), "<i8").reshape(-1, 2)
                    places.append((int(node[:8], 16) % shards, node, low, pair[:, 0], pair[:, 1], first[use].astype(np.int32)))
            rows = [(s, pack(b"".join(of), np.array([len(x) for x in of], np.int64), np.array(list(of.values()), np.int64))) for s, of in stretch.items()]
            names = ["shard", "blob", "node", "low", "hs", "ls", "starts"]
            whole = {"shard": "int32", "low": "int64"}  # no row is without `low`, as pandas would read 64 bits beside nulls as floats
            yield pd.DataFrame([(*r, None, 0, None, None, None) for r in rows], columns=names, dtype=object).astype(whole)
            yield pd.DataFrame([(s, None, *r) for s, *r in places], columns=names, dtype=object).astype(whole)

    sets = shared.groupBy("node").agg(F.collect_list("keys").alias("sets"))
    schema = f"shard int, blob binary, {PLACES}"
    return texts.join(sets, "node").select("node", "low", "data", "sets").mapInPandas(trimmed(find), schema)


def smallest_starts(text: np.ndarray, sizes: np.ndarray, lowest: np.ndarray, length: int, memory: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the joined stretches the number of the string of `length` bytes that starts there, and each one's smallest doc_id."""
    space = Space(memory, folder)
    offset = np.r_[0, np.cumsum(sizes)]
    order, shared = sort(text, length, space)
    group, n_groups, least = space.places(len(text)), 0, 0
    for a in range(0, len(order), BLOCK):
        at, common = np.asarray(order[a : a + BLOCK]), np.asarray(shared[a : a + BLOCK])
        whole = offset[np.searchsorted(offset, at, "right")] - at >= length  # others cross stretches
        keep = np.flatnonzero(whole)
        # Between two whole strings the least common prefix counts, of those that cross too.
        edges = np.r_[0, keep + 1]
        least_of = np.minimum.reduceat(np.r_[common, length], edges)[: len(keep)] if len(keep) else np.zeros(0, np.int64)
        tail = common[edges[-1] :]
        if len(keep):
            least_of[0] = min(least_of[0], least)
            new = least_of < length
            group[at[keep]] = n_groups + np.cumsum(new)
            n_groups += int(new.sum())
            least = int(tail.min()) if len(tail) else length
        else:
            least = min(least, int(tail.min()) if len(tail) else length)
    best = space.array(n_groups + 1, np.int64)
    best[:] = LAST
    for a in range(0, len(text), BLOCK):
        g = np.asarray(group[a : a + BLOCK])
        some = np.flatnonzero(g)
        np.minimum.at(best, g[some], lowest[np.searchsorted(offset, a + some, "right") - 1])
    return group, best


def may_share(text: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """For each of the joined stretches whether a string of it might stand elsewhere: both its first and its last four fifths have to."""
    gram = length * 4 // 5
    h = Keys(length, gram).grams(text)
    order = h.argsort()
    same = np.diff(h[order]) == 0
    twice = np.zeros(len(text), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice[: len(text) - length + gram] &= twice[length - gram :]
    offset = np.cumsum(sizes) - sizes
    twice &= np.arange(len(text)) <= np.repeat(offset + sizes - length, sizes)  # others cross stretches
    return np.logical_or.reduceat(twice, offset)


def runs_of(text: np.ndarray, names: np.ndarray, sizes: np.ndarray, lowest: np.ndarray, highest: np.ndarray, length: int, memory: int) -> Iterator[pd.DataFrame]:
    """The result rows of the joined stretches of a shard."""
    offset = np.r_[0, np.cumsum(sizes)]
    with tempfile.TemporaryDirectory() as folder:
        group, best = smallest_starts(text, sizes, lowest, length, memory, folder)
        for a in range(0, len(sizes), 1 << 14):
            b = min(a + (1 << 14), len(sizes))
            low = best[group[offset[a] : offset[b]]]
            of = np.repeat(np.arange(a, b), sizes[a:b])
            place = np.arange(offset[a], offset[b]) - offset[of]
            hit = (place <= sizes[of] - length) & (low < highest[of])
            turn = (low[1:] != low[:-1]) | (of[1:] != of[:-1])
            first = np.flatnonzero(hit & np.r_[True, ~hit[:-1] | turn])
            last = np.flatnonzero(hit & np.r_[~hit[1:] | turn, True])
            if len(first):
                own = of[first]
                cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                lists = [np.split(x, cuts[1:]) for x in (low[first], place[first].astype(np.int32), (place[last] + 1).astype(np.int32))]
                yield pd.DataFrame(dict(zip(("h", "l", "lows", "begins", "ends"), (names[own[cuts], 0], names[own[cuts], 1], *lists), strict=True)))


def repeated(rows: DataFrame, shards: int, length: int, memory: int = MEMORY) -> DataFrame:
    """(h, l, lows, begins, ends): for each stretch the runs [begin, end) of strings that a document has whose doc_id is smaller than that of
    another one with the stretch, by shard; and the rows (node, low, hs, ls, starts) as they are, so that stretches are shuffled but not stored."""

    def with_all(some) -> pd.DataFrame:
        out = pd.DataFrame(some)
        for name in ("h", "l", "lows", "begins", "ends", "node", "low", "hs", "ls", "starts"):
            if name not in out:
                out[name] = pd.array([None] * len(out), "Int64" if name in ("h", "l", "low") else object)
        return out

    def sorted_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        passing: list[pd.DataFrame] = []

        def blobs_only() -> Iterator[pd.DataFrame]:
            for batch in batches:
                of_text = batch["blob"].isna()
                passing.append(batch.loc[of_text, ["node", "low", "hs", "ls", "starts"]])
                yield batch[~of_text]

        for blobs in grouped(blobs_only()):
            number: dict[bytes, int] = {}
            keys, lowest, highest = [], [], []
            for blob in blobs:
                joined, sizes, lows = unpack(blob)
                ends = np.cumsum(sizes)
                for e, n, (key, low, high) in zip(ends.tolist(), sizes.tolist(), lows.tolist(), strict=True):
                    k = number.setdefault(joined[e - n : e], len(number))
                    if k == len(lowest):
                        keys.append(key)
                        lowest.append(low)
                        highest.append(high)
                    else:
                        lowest[k], highest[k] = min(lowest[k], low), max(highest[k], high)
            lowest, highest = np.array(lowest, np.int64), np.array(highest, np.int64)
            _, which, times = np.unique(np.array(keys, np.int64), return_inverse=True, return_counts=True)
            sole = times[which] == 1
            names = np.frombuffer(b"".join(xxhash.xxh3_128_intdigest(x).to_bytes(16, "little") for x in number), "<i8").reshape(-1, 2)
            sizes = np.array([len(x) for x in number], np.int64)
            # Equal strings have equal keys, so the strings of a key's only stretch stand in no other.
            # So parts by key can be sorted one after the other.
            stretches = list(number)
            del number
            part = which % max(1, -(-int(sizes[~sole].sum()) // (memory // PART)))
            part[sole] = -1
            order = part.argsort(kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                if part[own[0]] < 0:
                    continue
                text = np.frombuffer(b"".join(stretches[i] for i in own.tolist()), np.uint8)
                share = may_share(text, sizes[own], length)
                sole[own[~share]] = True
                text, own = text[np.repeat(share, sizes[own])], own[share]
                if len(own):
                    yield from map(with_all, runs_of(text, names[own], sizes[own], lowest[own], highest[own], length, memory))
            some = np.flatnonzero(sole & (lowest < highest))
            if len(some):
                yield with_all({"h": names[some, 0], "l": names[some, 1], "lows": list(lowest[some, None]), "begins": list(np.zeros((len(some), 1), np.int32)), "ends": list((sizes[some, None] - length + 1).astype(np.int32))})
            yield from map(with_all, passing)
            passing.clear()
        yield from map(with_all, passing)

    return by_shard(rows, shards).mapInPandas(trimmed(sorted_), f"h long, l long, lows array<long>, begins array<int>, ends array<int>, {PLACES}")


def covered(found: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """(node, spans): the intervals [start, end) of each text that repeat a text of smaller doc_id."""
    places = found.select("node", "low", F.explode(F.arrays_zip("hs", "ls", "starts")).alias("p")).select("node", "low", F.col("p.hs").alias("h"), F.col("p.ls").alias("l"), "p.starts")
    smaller = F.filter(F.arrays_zip("lows", "begins", "ends"), lambda r: r["lows"] < F.col("low"))
    spans = F.transform(smaller, lambda r: F.struct((F.col("starts") + r["begins"]).alias("a"), (F.col("starts") + r["ends"] + (length - 1)).alias("b")))
    hit = places.join(runs, ["h", "l"]).select("node", spans.alias("spans")).where(F.size("spans") > 0)
    return hit.groupBy("node").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], bytes]:
    """(maximal removed runs, what is left)."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    return [(a, b) for a, b in runs], b"".join([*kept, data[at:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), and with_text the bytes left as `kept` (null: the text as it is)."""
    spark = docs.sparkSession
    shards = shuffle_partitions(spark)
    text = text_or_empty("text")
    base = docs.select("doc_id", F.md5(text).alias("node"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    low = F.min(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
    once = base.where(F.col("n_bytes") >= length).groupBy("node").agg(low.alias("low"), F.first("text").alias("text"))
    name = f"corpusloom_texts_{uuid.uuid4().hex}"
    once.select("node", "low", F.encode("text", "UTF-8").alias("data")).repartition(shards, "node").write.bucketBy(shards, "node").option("compression", "zstd").option("path", f"{shared_dir(spark)}/corpusloom/{name}").saveAsTable(name)
    try:
        texts = spark.table(name)
        keys = materialize(shared_keys(key_rows(texts, shards, length), shards), "keys")
        found = materialize(repeated(stretch_rows(texts, keys, shards, length), shards, length), "runs")
        drop_table(keys)
        runs = found.where("h is not null").select("h", "l", "lows", "begins", "ends")
        spans = covered(found.where("node is not null").select("node", "low", "hs", "ls", "starts"), runs, length)

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for node, data, own in zip(batch["node"], batch["data"], batch["spans"], strict=True):
                    runs, kept = cut(data, [(x["a"], x["b"]) for x in own])
                    out.append((node, sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
                yield pd.DataFrame(out, columns=["node", "n_removed", "n_spans", "sha", "kept"])

        judged = texts.join(spans, "node").select("node", "data", "spans").mapInPandas(trimmed(judge), "node string, n_removed long, n_spans long, sha string, kept binary")
        known = materialize(texts.select("node", "low").join(judged, "node", "left"), "judged")
    finally:
        drop_table(spark.table(name))
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    plain = base.select("doc_id", "node", "n_bytes", F.sha2("text", 256).alias("own_sha"))
    copy = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) > F.col("low")
    out = plain.join(known, "node", "left").select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "own_sha")).alias("kept_sha256"),
        F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
    return out if with_text else out.drop("kept")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
