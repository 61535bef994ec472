"""Near-duplicates by BagMinHash over bags of five-word shingles.

Each distinct text is a bag: shingles with their counts. The counts are discretised weights; a shingle's weight range is split
into the dyadic intervals [0,1), [1,2), [2,4), [4,8), ..., and every interval has a Poisson process with as much intensity as
it is wide, whose points carry a signature slot and, inside the interval, a level. A bag meets the points whose level is below
its count, so a shingle of count c costs about log2(c) processes; points are drawn in ascending order and a process stops when
it passes the bag's largest slot value. Two bags agree in a slot with a probability equal to their weighted Jaccard similarity.

`BANDS` bands of `ROWS` slots give buckets (at a similarity of 0.8 two bags share none with probability 2e-4). A text is first compared
with the centre that most of its buckets share; a bucket's centre is the member that meets most others, so in a family of copies
it is the one that they were made from. Links are verified by the exact overlap of the bags, components are formed, and in
buckets whose members are still in different components those outside the bucket's largest component meet the members of all
other components, until each bucket is settled: a few a round at first, those that meet most others before the rest, so that
most are in the large component before their turn comes. So no pair of a bucket goes untested unless its two texts
already are in one class, there is no cap, and pairs inside a component are never emitted. A large bucket's members are dealt
to parts, each of which meets a copy of the bucket's leaders. Four bits of each slot go along: pairs that
differ in more slots than those at the threshold do by 4 standard deviations (3 in 100,000 at exactly 0.8) are dropped inside the
join, and a pair that shares several buckets is met in the first of them only.

Equal texts are one node of all this, by their MD5. Texts are shuffled only for the pairs to verify.

Edge cases: null and wordless texts have no bag; they form a class with equal texts alone (null and empty are equal). Texts of
fewer than five words are one shingle. A class is named by its smallest doc_id (null if it has none); repeated rows are copies;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_table, fresh, map_rows, materialize, quoted, table, text_or_empty, trimmed
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 36, 7
LEADERS = 16  # of a bucket in the first round; sixteen times as many in each next one
PART = 4096  # members of a bucket, about, in a part that meets its leaders; as many as there are leaders in late rounds
SLOTS = 2 * BANDS * ROWS  # as many slots again sharpen the sketch
SKETCH = [f"s{i}" for i in range(-(-SLOTS // 16))]
BROADCAST_NODES = 200_000
WORD = re.compile(r"\w+")
GOLD = np.uint64(0x9E3779B97F4A7C15)


def times_gold(k: int) -> np.uint64:
    return np.uint64(k * int(GOLD) & 0xFFFFFFFFFFFFFFFF)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hasher:
    """64-bit hashes of words, kept for words seen before."""

    def __init__(self, most: int = 100_000):
        self.seen: dict[str, int] = {}
        self.most = most

    def bag(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(shingle hashes, counts) of a text, hashes ascending."""
        words = WORD.findall((text or "").lower())
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.seen) > self.most:
            self.seen.clear()
        seen, of = self.seen, xxhash.xxh3_64_intdigest
        for w in words:
            if w not in seen:
                seen[w] = of(w)
        h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        k = min(SHINGLE, len(h))
        n = len(h) - k + 1
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = mix((out ^ h[i : i + n]) + GOLD)
        return np.unique(out, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags: the overlap of the multisets over their union."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    overlap = int(np.minimum(a[1][both], b[1][at[both]]).sum())
    return overlap / (int(a[1].sum()) + int(b[1].sum()) - overlap)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = SLOTS) -> np.ndarray:
    """BagMinHash signatures [bags, m] of non-empty bags."""
    n = len(bags)
    owner = np.repeat(np.arange(n), [len(b[0]) for b in bags])
    key, count = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags])
    parts = [(owner, key, count, np.zeros(len(key), np.int64), np.ones(len(key), np.int64))]
    low = 1
    while (count > low).any():  # the interval [low, 2 low), as wide as its start
        some = count > low
        parts.append((owner[some], mix(key[some] + times_gold(low)), count[some], np.full(int(some.sum()), low), np.full(int(some.sum()), low)))
        low *= 2
    owner, key, count, low_, width = (np.concatenate(p) for p in zip(*parts, strict=True))
    sig = np.full(n * m, np.inf)
    most = np.full(n, np.inf)
    x = np.zeros(len(key))
    turn = 0
    while len(key):
        turn += 1
        h = mix(key + times_gold(turn))
        x = x - np.log(((h >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) / width
        g = mix(h)
        slot = ((g >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
        wide = width > 1
        met = np.ones(len(key), bool)
        if wide.any():
            level = low_ + ((g & np.uint64(0xFFFFFFFF)).astype(np.int64) * width >> 32)
            met = level < count
        np.minimum.at(sig, (owner * m + slot)[met], x[met])
        changed = np.unique(owner) if len(owner) < n else np.arange(n)
        most[changed] = sig.reshape(n, m)[changed].max(axis=1)
        go = x < most[owner]
        owner, key, count, low_, width, x = owner[go], key[go], count[go], low_[go], width[go], x[go]
    return sig.reshape(n, m)


def bands(sig: np.ndarray) -> np.ndarray:
    """Bucket hashes [bags, BANDS]."""
    v = np.ascontiguousarray(sig[:, : BANDS * ROWS]).view(np.uint64).reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * GOLD, (len(sig), BANDS)).copy()
    for r in range(ROWS):
        out = mix((out ^ v[:, :, r]) + GOLD)
    return out.view(np.int64)


def sketched(docs: DataFrame, batch_docs: int = 512) -> DataFrame:
    """(doc_id, node, bands, sketch): a row a document; bands and sketch (four bits a slot) once for equal texts of a batch, and null for texts without words."""

    def start():
        hasher = Hasher()

        def sketch(names: list[str], texts: list[str]):
            band, byte = [None] * len(names), [None] * len(names)
            for a in range(0, len(names), batch_docs):
                seen: set[str] = set()
                use, bags = [], []
                for i in range(a, min(a + batch_docs, len(names))):
                    if names[i] not in seen:
                        seen.add(names[i])
                        bag = hasher.bag(texts[i])
                        if len(bag[0]):
                            use.append(i)
                            bags.append(bag)
                if use:
                    sig = signatures(bags)
                    four = np.zeros((len(use), 16 * len(SKETCH)), np.uint64)
                    four[:, :SLOTS] = mix(sig.view(np.uint64)) & np.uint64(15)
                    packed = (four.reshape(len(use), -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)
                    for i, b, s in zip(use, bands(sig), packed, strict=True):
                        band[i], byte[i] = b, s
            return None, [band, byte]

        return sketch

    text = text_or_empty("text")
    keyed = docs.select("doc_id", F.md5(text).alias("node"), text.alias("text"))
    return map_rows(keyed, ["doc_id", "node"], ["node", "text"], "bands array<long>, sketch array<long>", start)


def near(a: str, b: str, threshold: float) -> Column:
    """Whether the sketches of two aliased tables are near enough: a slot differs with probability (1 - similarity) * 15 / 16."""
    p = (1 - threshold) * 15 / 16
    far = SLOTS * p + 4 * (SLOTS * p * (1 - p)) ** 0.5
    out = F.lit(0)
    for s in SKETCH:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        out = out + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return out <= far


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of nids whose bags are as similar as threshold, with the similarity."""
    needed = pairs.select(F.col("a").alias("nid")).union(pairs.select("b")).distinct()
    needed = materialize(nodes.select("nid", "node").join(needed, "nid", "left_semi"), "needed")
    # Few nodes go to where the texts are; many meet them by a shuffle.
    small = F.broadcast(needed) if needed.count() <= BROADCAST_NODES else needed
    text = text_or_empty("text")
    texts = docs.select(F.md5(text).alias("node"), text.alias("text")).join(small, "node").dropDuplicates(["nid"])
    texts = materialize(texts.select("nid", "text"), "texts")
    a, b = texts.select(F.col("nid").alias("a"), F.col("text").alias("ta")), texts.select(F.col("nid").alias("b"), F.col("text").alias("tb"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        held: dict[int, tuple] = {}

        def bag(i: int, t: str) -> tuple:
            if i not in held:
                if len(held) > 2048:
                    held.clear()
                held[i] = hasher.bag(t)
            return held[i]

        for batch in batches:
            out = [similarity(bag(x, tx), bag(y, ty)) for x, y, tx, ty in zip(batch["a"], batch["b"], batch["ta"], batch["tb"], strict=True)]
            yield batch[["a", "b"]].assign(similarity=out)

    joined = pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb")
    return materialize(joined.mapInPandas(trimmed(compare), "a long, b long, similarity double").where(F.col("similarity") >= threshold), "links")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, node, label): one row a document; label names the class by a number. Documents of a class are linked by texts of similarity threshold or more."""
    sketches = materialize(sketched(docs), "sketches")
    nodes = sketches.where("bands is not null").select("node", "bands", *[F.col("sketch")[i].alias(c) for i, c in enumerate(SKETCH)])
    nodes = materialize(nodes.dropDuplicates(["node"]).withColumn("nid", F.monotonically_increasing_id()), "nodes")
    bits = nodes.select("nid", "bands", *SKETCH)
    members = nodes.select("nid", F.explode("bands").alias("hash"))
    shared = members.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    open_ = materialize(members.join(shared, "hash"), "buckets")
    mass = materialize(open_.groupBy("nid").agg(F.sum("n").alias("mass")), "mass")
    centers = open_.join(mass, "nid").groupBy("hash").agg(F.max(F.struct("mass", "nid")).alias("top")).select("hash", F.col("top.nid").alias("center"), F.col("top.mass").alias("mass"))
    votes = open_.join(centers, "hash").where("nid <> center").groupBy("center", "nid").agg(F.count(F.lit(1)).alias("n"), F.max("mass").alias("mass"))
    best = votes.groupBy("nid").agg(F.max(F.struct("n", "mass", "center")).alias("best")).select(F.least("best.center", "nid").alias("a"), F.greatest("best.center", "nid").alias("b"))
    sketch_only = nodes.select("nid", *SKETCH)
    joined = best.distinct().join(sketch_only.alias("x"), F.col("a") == F.col("x.nid")).join(sketch_only.alias("y"), (F.col("b") == F.col("y.nid")) & near("x", "y", threshold))
    pairs = materialize(joined.select("a", "b"), "pairs")
    links = verified(pairs, nodes, docs, threshold)
    tested = pairs
    labels = components(links)
    left, most = open_.select("hash", "nid").join(mass, "nid"), LEADERS
    while True:
        named = left.join(labels.select(F.col("node").alias("nid"), "label"), "nid", "left").select("hash", "nid", "mass", F.coalesce("label", "nid").alias("label"))
        per = named.groupBy("hash", "label").agg(F.count(F.lit(1)).alias("n"))
        mixed = per.groupBy("hash").agg(F.max(F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("labels"), F.sum("n").alias("members")).where("labels > 1")
        # A bucket is dealt by hash to parts of about `part` members, and its leaders go to each part: about as many rows as the bucket has.
        part = max(PART, most)
        left = materialize(named.join(mixed.select("hash", F.col("top.label").alias("major"), F.ceil(F.col("members") / part).alias("parts")), "hash"), "mixed")
        if not left.limit(1).count():
            break
        # Every pair between components has a member outside the largest one; up to `most` of those a bucket meet all others now.
        order = F.row_number().over(Window.partitionBy("hash").orderBy(F.desc("mass"), "nid"))
        leaders = left.where("label <> major").withColumn("rank", order).where(F.col("rank") <= most).select("hash", "nid", "label", "parts")
        leaders = materialize(leaders, "leaders")
        marked = left.join(leaders.select("hash", "nid", F.lit(True).alias("leads")), ["hash", "nid"], "left").withColumn("leads", F.coalesce("leads", F.lit(False)))
        marked = materialize(marked, "marked")
        first = F.try_element_at(F.filter(F.zip_with("x.bands", "y.bands", lambda p, q: F.when(p == q, p)), lambda p: p.isNotNull()), F.lit(1)) == F.col("x.hash")
        on = (F.col("x.hash") == F.col("y.hash")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.label") != F.col("y.label")) & near("x", "y", threshold) & first
        x = marked.withColumn("part", F.pmod(F.xxhash64("nid"), "parts")).join(bits, "nid").alias("x")
        y = leaders.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).join(bits, "nid").alias("y")
        met = x.join(y, on & (~F.col("x.leads") | (F.col("x.nid") < F.col("y.nid")))).select(F.least("x.nid", "y.nid").alias("a"), F.greatest("x.nid", "y.nid").alias("b"))
        more = materialize(met.join(tested, ["a", "b"], "left_anti"), "pairs")
        if more.limit(1).count():
            new = verified(more, nodes, docs, threshold)
            tested = tested.unionByName(more)
            if new.limit(1).count():
                links = links.unionByName(new)
                labels = components(links)
        drop_table(left)
        drop_table(leaders)
        left = marked.where("not leads").select("hash", "nid", "mass")
        most *= 16
    ids = sketches.groupBy("node").agg(F.min("doc_id").alias("low")).join(nodes.select("node", "nid"), "node", "left")
    # A text without words has no nid; it is a class of its own, numbered below zero.
    ids = materialize(ids.withColumn("nid", F.coalesce("nid", -1 - F.monotonically_increasing_id())), "ids")
    named = materialize(ids.join(labels.withColumnRenamed("node", "nid"), "nid", "left").select("node", "low", F.coalesce("label", "nid").alias("label")), "named")
    least = named.groupBy("label").agg(F.min("low").alias("class_id"))
    of_node = materialize(named.join(least, "label").select("node", "label", "class_id"), "classes")
    return sketches.select("doc_id", "node").join(of_node, "node").select("doc_id", "class_id", "node", "label")


def survivors(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id."""
    found = classes(docs, threshold)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    pair, own = F.concat_ws(":", F.col("k.node"), F.coalesce(F.col("k.doc_id").cast("string"), F.lit("null"))), fresh(docs, "pair")
    kept = materialize(found.groupBy("label").agg(F.min(key).alias("k")).select(pair.alias(own)), "kept")
    marked = docs.withColumn(own, F.concat_ws(":", F.md5(text_or_empty("text")), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    # One row a class carries this pair, so rows that repeat it are copies of that row. One key, so texts are shuffled once.
    return marked.join(kept, own, "left_semi").dropDuplicates([own]).select(*map(quoted, docs.columns))


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
