"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots (thousands). Bytes are summed per slot; a versioned slot-to-shard
map assigns slots to shards so that bytes come out near equal (largest slot first, to the lightest shard). A rebalance
edits the map: it writes a new version in which only the slots that must move change their shard.

Plan: one pass over the texts for sizes and hashes (24 bytes a row survive it), one aggregation to at most `n_slots`
rows (pre-aggregated map-side), the map on the driver (`n_slots` rows, a constant), a broadcast join with that map, and
one window per `PARTS`th of a slot for the row's place in its shard. Equal rows are counted and numbered, and all but the first hash with their
number, so repeated rows spread over the slots like any others and places do not depend on the files.
The map is stored below the shared folder and rows are assigned by the version that is read back.

Edge cases: a null text has no bytes (size 1, checksum 0 of the empty string); a null doc_id hashes like any other
value; repeated rows keep one output row each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, quoted, shared_dir, table, text_or_empty

N_SLOTS, PARTS, RUN = 4096, 16, 4096
MAP_SCHEMA = "version int, virtual_slot int, shard int, slot_bytes long, slot_rows long"


def slot_columns(n_slots: int = N_SLOTS) -> dict[str, Column]:
    """size, text_crc32 and virtual_slot. The slot depends on doc_id and the text's checksum only, never on shards."""
    text = text_or_empty("text")
    crc = F.crc32(F.encode(text, "UTF-8"))
    return {
        "size": F.octet_length(text).cast("long") + F.lit(1),
        "text_crc32": crc,
        "virtual_slot": F.pmod(F.xxhash64(F.col("doc_id"), crc), F.lit(n_slots)).cast("int"),
    }


def with_slots(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot)."""
    return docs.select("doc_id", *[c.alias(k) for k, c in slot_columns(n_slots).items()])


def slot_loads(slotted: DataFrame) -> list[tuple[int, int, int]]:
    """(virtual slot, bytes, rows); at most one row per slot, a constant number."""
    rows = slotted.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return [(r["virtual_slot"], r["b"], r["n"]) for r in rows]


def balance(loads: list[tuple[int, int, int]], n_shards: int) -> dict[int, int]:
    """Slot-to-shard map: heaviest slot first, always to the shard with the fewest bytes."""
    heap = [(0, s) for s in range(n_shards)]
    out: dict[int, int] = {}
    for slot, size, _ in sorted(loads, key=lambda x: (-x[1], x[0])):
        total, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (total + size, shard))
    return out


def rebalance(old: dict[int, int], loads: list[tuple[int, int, int]], n_shards: int) -> dict[int, int]:
    """Edit a map for a new shard count or new loads, moving few slots.

    Slots of removed shards and, from shards above the mean, the slots that fit best move to the lightest shards; all
    others stay where they are.
    """
    size = {s: b for s, b, _ in loads}
    mean = sum(size.values()) / max(1, n_shards)
    per: dict[int, list[int]] = {s: [] for s in range(n_shards)}
    loose = []
    for slot in sorted(size):
        shard = old.get(slot)
        (per[shard] if shard is not None and shard < n_shards else loose).append(slot)
    new = {}
    for shard, slots in per.items():
        total = sum(size[s] for s in slots)
        for s in sorted(slots, key=lambda s: (-size[s], s)):
            if total - size[s] >= mean:
                total -= size[s]
                loose.append(s)
            else:
                new[s] = shard
    totals = dict.fromkeys(range(n_shards), 0)
    for s, shard in new.items():
        totals[shard] += size[s]
    heap = [(b, s) for s, b in totals.items()]
    heapq.heapify(heap)
    for s in sorted(loose, key=lambda s: (-size[s], s)):
        total, shard = heapq.heappop(heap)
        new[s] = shard
        heapq.heappush(heap, (total + size[s], shard))
    return new


def map_frame(spark: SparkSession, mapping: dict[int, int], loads: list[tuple[int, int, int]], version: int) -> DataFrame:
    by_slot = {s: (b, n) for s, b, n in loads}
    rows = [(version, s, mapping[s], *by_slot[s]) for s in sorted(mapping)]
    return spark.createDataFrame(rows, MAP_SCHEMA)


def write_map(frame: DataFrame, path: str, version: int = 1) -> None:
    """Store one version of the map; a version that is there already is left alone and raises."""
    frame.drop("version").write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> dict[int, int]:
    """One version of the stored map, the newest by default; n_slots rows at most."""
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    version = stored.agg(F.max("version")).first()[0] if version is None else version
    return {r["virtual_slot"]: r["shard"] for r in stored.where(F.col("version") == version).collect()}


def edit_map(spark: SparkSession, path: str, loads: list[tuple[int, int, int]], n_shards: int) -> int:
    """Rebalance the newest stored version for these loads and store it as the next one, whose number is returned."""
    newest = spark.read.schema(MAP_SCHEMA).parquet(path).agg(F.max("version")).first()[0]
    version = newest + 1
    write_map(map_frame(spark, rebalance(read_map(spark, path, newest), loads, n_shards), loads, version), path, version)
    return version


def assign(slotted: DataFrame, mapping: dict[int, int]) -> DataFrame:
    """Add shard and slot (the row's place in its shard, gapless from 0) to rows (doc_id, size, text_crc32, copy, virtual_slot, part)."""
    spark = slotted.sparkSession
    rows = [(s, shard) for s, shard in mapping.items()]
    shards = spark.createDataFrame(rows, "virtual_slot int, shard int")
    counts = slotted.groupBy("virtual_slot", "part").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(shards), "virtual_slot")
    order = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    # n_slots * PARTS rows at most, a constant.
    starts = counts.select("virtual_slot", "part", "shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("slot_start"))
    within = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size", "copy")
    return (
        slotted.join(F.broadcast(starts), ["virtual_slot", "part"])
        .withColumn("slot", (F.row_number().over(within) - 1 + F.col("slot_start")).cast("long"))
        .drop("slot_start", "part")
    )


def numbered_copies(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, copy, virtual_slot, part): a row for each row of docs, equal ones numbered from 0, whose number takes part in the slot.

    Equal rows are counted, not gathered, and dealt out again from their count in runs of `RUN`, so neither their order nor the files matter and no task makes more
    than a run of one group at a time.
    """
    groups = with_slots(docs, n_slots).groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))).alias("run")
    runs = materialize(groups.select("doc_id", "size", "text_crc32", "n", run), "copies")
    first = F.col("run") * RUN
    copies = runs.select("doc_id", "size", "text_crc32", F.explode(F.sequence(first, F.least(first + RUN, F.col("n")) - 1)).alias("copy"))
    h = F.when(F.col("copy") == 0, F.xxhash64("doc_id", "text_crc32")).otherwise(F.xxhash64("doc_id", "text_crc32", "copy"))
    part = F.pmod(F.xxhash64("text_crc32", "copy", "doc_id"), F.lit(PARTS)).cast("int")
    return copies.select("*", F.pmod(h, F.lit(n_slots)).cast("int").alias("virtual_slot"), part.alias("part"))


def shard_documents(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Rows of docs (doc_id, size, text_crc32, virtual_slot) with shard and slot, by version 1 of a map that is stored at map_path."""
    spark = docs.sparkSession
    slotted = materialize(numbered_copies(docs, n_slots), "slots")
    loads = slot_loads(slotted)
    return assign(slotted, stored_map(spark, loads, n_shards, map_path)).drop("copy")


def stored_map(spark: SparkSession, loads: list[tuple[int, int, int]], n_shards: int, map_path: str | None) -> dict[int, int]:
    """Version 1 of the map for these loads, as stored at map_path (a new folder below the shared one by default) and read back."""
    path = map_path or f"{shared_dir(spark)}/corpusloom/slot-map-{uuid.uuid4().hex}"
    write_map(map_frame(spark, balance(loads, n_shards), loads, 1), path)
    return read_map(spark, path, 1)


def placed(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """docs with virtual_slot and shard (columns of these names are replaced), by the stored map; no shuffle of texts."""
    mapping = stored_map(docs.sparkSession, slot_loads(with_slots(docs, n_slots)), n_shards, map_path)
    frame = docs.sparkSession.createDataFrame(list(mapping.items()), "virtual_slot int, shard int")
    kept = [quoted(c) for c in docs.columns if c not in frame.columns]
    return docs.select(*kept, slot_columns(n_slots)["virtual_slot"].alias("virtual_slot")).join(F.broadcast(frame), "virtual_slot").select(*kept, "virtual_slot", "shard")


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), 8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
