"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint is the 64-bit majority vote of the XXH64 hashes of its three-word shingles, repeats included. Two
fingerprints link at `RADIUS` = 3 or fewer differing bits. Every fingerprint is cut into two segments of 32 bits, so linked ones differ
in at most one bit of one of the segments. Each distinct fingerprint stands in the table of each segment under its value there, and
looks into the table at the values with one set bit cleared: of two values that differ in one bit, one is the other with a
bit cleared, so half of the Hamming ball of radius 1 meets every pair once. What meets in a table slot is verified by
its whole distance.

A slot never emits its pairs. It emits a spanning forest of the links among its members, found breadth first: each member is compared
with those not yet reached, so links number less than members and no link between different components is lost. A slot of more than
`SLOT` members (a large family of near copies) is dealt again by the two 16-bit segments of its other half in the same way; 48 bits
are then fixed, so what meets there is bounded by 2^16 times the 17 x 33 values that look in, whatever the table. Equal fingerprints
are one row before any of this, so copies cost nothing.

Edge cases: null, empty and wordless texts have fingerprint zero, linked like any other; texts of one or two words are one
shingle. A component is named by its smallest doc_id, nulls aside (null if it has none); repeated rows come back as often as they came;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, materialize, table, text_or_empty, trimmed
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
SLOT = 4096
BLOCK = 1 << 15  # shingles voted on at once


def simhash(text: bytes) -> int:
    """The unsigned fingerprint of a text in UTF-8."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    k = min(SHINGLE, len(words))
    starts, ends = (ends - size)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    votes, of = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for a in range(0, len(starts), BLOCK):
        h = np.array([of(joined[s:e], SEED) for s, e in zip(starts[a : a + BLOCK], ends[a : a + BLOCK], strict=True)], np.dtype("<u8"))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and fp, the fingerprint as a signed long."""
    keyed = docs.select(*keep, text_or_empty("text").cast("binary").alias("utf8"))

    def start():
        return lambda texts: (None, [np.array([simhash(t) for t in texts], np.uint64).view(np.int64)])

    return map_rows(keyed, keep, ["utf8"], "fp long", start)


def forest(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (a, b) that span the components of distinct fingerprints, by blocks."""
    out, left = [], fps
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= RADIUS
            if near.any():
                hit = left[near]
                out.append((np.full(len(hit), x), hit))
                front.extend(hit)
                left = left[~near]
    return out


def variants(value: Column, bits: int) -> Column:
    """The value itself, then the value with each of its set bits cleared."""
    masks = F.array(*[F.lit(1 << b).cast("long") for b in range(bits)])
    return F.concat(F.array(value), F.transform(F.filter(masks, lambda m: value.bitwiseAND(m) != 0), lambda m: value.bitwiseXOR(m)))


def dealt(fps: DataFrame, keep: list[str], first: Column, second: Column, bits: int, slot: str) -> DataFrame:
    """Rows (keep, fp, slot, own): each fingerprint in the slots that it stands in or looks into, by two segments of so many bits."""

    def segment(value: Column, tag: int) -> Column:
        mark = F.lit(tag << bits).cast("long")
        return F.transform(variants(value, bits), lambda v, i: F.struct(v.bitwiseOR(mark).alias("slot"), (i == 0).alias("own")))

    met = fps.select(*keep, "fp", F.explode(F.concat(segment(first, 0), segment(second, 1))).alias("m"))
    return met.select(*keep, "fp", F.col("m.slot").alias(slot), F.col("m.own").alias("own"))


def met_in_slots(batches: Iterator, n_slot: int, most: int | None) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(first slot column, fingerprints, over) of every slot with a member of its own and one more; rows come ordered by slot.

    Members of a slot of more than `most` come in several parts, marked as over, as they are read.
    """
    held, over_key = None, None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_slot + 2)]
        if held is not None:
            cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        new = np.ones(len(cols[0]), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in cols[:n_slot]], axis=0)
        at = np.append(np.flatnonzero(new), len(new))
        fps, key = cols[n_slot].view(np.uint64), lambda i: tuple(int(k[i]) for k in cols[:n_slot])  # noqa: B023
        useful = (np.diff(at) > 1) & (np.add.reduceat(cols[n_slot + 1].astype(np.int64), at[:-1]) > 0)
        if over_key is not None and over_key == key(0):
            useful[0] = True
        for i in np.flatnonzero(useful[:-1]):
            s, e = at[i], at[i + 1]
            yield int(cols[0][s]), fps[s:e], most is not None and (e - s > most or (i == 0 and key(0) == over_key))
        s = at[-2]
        if most is not None and (len(fps) - s > most or key(s) == over_key):
            yield int(cols[0][s]), fps[s:], True
            held, over_key = None, key(s)
        else:
            held, over_key = [c[s:] for c in cols], None
    if held is not None and len(held[0]) > 1 and held[n_slot + 1].any():
        yield int(held[0][0]), held[n_slot].view(np.uint64), False


def linked(met: DataFrame, slot: list[str], most: int | None = None) -> DataFrame:
    """(a, b, slot): links within slots; members of slots of more than `most` come back with b null and their slot."""
    n_slot = len(slot)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        links, over, size = [], [], 0

        def made():
            a = np.concatenate([x for x, _ in links + over]).view(np.int64)
            n = sum(len(x) for x, _ in links)
            b, at = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
            if links:
                b[:n] = np.concatenate([y for _, y in links]).view(np.int64)
            if over:
                at[n:] = np.concatenate([np.full(len(x), k) for x, k in over])
            linked_ = np.arange(len(a)) < n
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=~linked_), pa.array(at, mask=linked_)], names=["a", "b", "slot"])

        for key, fps, is_over in met_in_slots(batches, n_slot, most):
            found = [] if is_over else forest(fps)
            links += found
            over += [(fps, key)] if is_over else []
            size += len(fps) if is_over else sum(len(x) for x, _ in found)
            if size > 1 << 16:
                yield made()
                links, over, size = [], [], 0
        if size:
            yield made()

    rows = met.select(*slot, "fp", "own").repartition(*slot).sortWithinPartitions(*slot)
    return rows.mapInArrow(trimmed(run), "a long, b long, slot long")


def links(fps: DataFrame, most: int = SLOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that span all their components."""
    low = F.lit(0xFFFFFFFF).cast("long")
    whole = dealt(fps, [], F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(low), 32, "slot")
    found = materialize(linked(whole, ["slot"], most), "simhash")
    again = found.where("slot is not null").select(F.col("a").alias("fp"), "slot").distinct()
    other = F.when(F.col("slot") < F.lit(1 << 32), F.col("fp").bitwiseAND(low)).otherwise(F.shiftrightunsigned("fp", 32))
    parts = dealt(again, ["slot"], F.shiftright(other, 16), other.bitwiseAND(F.lit(0xFFFF).cast("long")), 16, "part")
    direct = found.where("slot is null").select("a", "b")
    if not again.limit(1).count():
        return direct
    return direct.unionByName(linked(parts, ["slot", "part"]).select("a", "b"))


def simhash_components(docs: DataFrame, keep: str = "doc_id", most: int = SLOT) -> DataFrame:
    """(keep, fp, component_id): the fingerprint and the smallest id that its links reach."""
    prints = materialize(fingerprints(docs, [keep]), "prints")
    least = materialize(prints.groupBy("fp").agg(F.min(keep).alias("least")), "distinct")
    labels = components(links(least.select("fp"), most))
    named = least.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = materialize(named, "named")
    lowest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(lowest, "label").select("fp", "component_id"), "fp").select(keep, "fp", "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
