"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled, repeatable order, repeated up to `epochs` times. A document's
virtual finish time is the cumulative tokens of its source up to and including it, divided by the source's target.
All copies of all queues are ordered by virtual finish time and the order is cut at the total budget.

No global sort is needed for the cut: tokens are summed per virtual-time range (`n_ranges` equal ranges, the range
partitioning of the order), the range in which the running sum meets the budget is found from those few sums, and only
that range is sorted. The running sum inside a source works the same way over hash ranges of the shuffled order, so a
source that holds a third of all rows is spread over 16 ** `bucket_digits` windows.

Edge cases: a null text has size 0 and is never taken; null is a source of its own, ordered last; repeated rows and
repeated doc_ids are separate queue entries; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, quoted, table, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUCKET_DIGITS = 3
N_RANGES = 4096
EDGE_ROWS = 10_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target): share of all sizes by weight, each target at most cap times its source's size.

    The excess of capped sources goes to the others by weight until none is above its cap: sources in the order of
    cap / weight, the first k of them capped for the smallest k that leaves a level under all other caps. The table has one
    row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = per.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = (
        ranked.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    )
    return levels.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("final"), F.lit(float("inf"))) * F.col("weight")).alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """Add size, the words of the text."""
    return docs.withColumn("size", F.regexp_count(text_or_empty("text"), F.lit(WORD)).cast("long"))


def shuffle_key(seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("size").cast("string")))


def mix(sizes: DataFrame, targets: DataFrame, epochs: int = 2, seed: int = 7, bucket_digits: int = BUCKET_DIGITS, n_ranges: int = N_RANGES, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """sizes (doc_id, source, size) and targets (source, source_size, target), one row per source.

    Adds source_size, target, taken (tokens the mix takes, repeats counted) and copies. Equal keys of the order are
    equal rows (same source, doc_id and size), so ties do not change the result.
    """
    keyed = sizes.withColumn("key", shuffle_key(seed)).withColumn("bucket", F.substring("key", 1, bucket_digits))
    at = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
        .withColumn("start", F.coalesce(F.sum("bucket_size").over(at), F.lit(0))).select("source", "bucket", "start")
    )
    starts = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    a, b = keyed.alias("a"), starts.alias("b")
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.bucket") == F.col("b.bucket")))
        .select("a.*", "start", "source_size", "target")
        .withColumn("upto", F.col("start") + F.sum("size").over(within))
        .withColumn("finish", F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda e: F.when(F.col("target") > 0, (F.col("source_size") * e + F.col("upto")) / F.col("target"))))
    )
    placed = materialize(placed.drop("start", "bucket", "upto"), "mix")
    copies = placed.where("size > 0").select("key", "doc_id", "source", "size", F.explode("finish").alias("vft")).where("vft is not null")
    budget = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    taken = _taken(copies, budget, n_ranges, edge_rows)
    n = F.aggregate("finish", F.lit(0), lambda acc, vft: acc + F.when((F.col("size") > 0) & vft.isNotNull() & taken(vft), 1).otherwise(0))
    return placed.withColumn("copies", n).withColumn("taken", (F.col("copies") * F.col("size")).cast("long")).drop("finish", "key")


def _taken(copies: DataFrame, budget: float, n_ranges: int, edge_rows: int):
    """vft column -> whether that copy is within the budget; the edge range is split again until it has at most edge_rows rows."""
    found = copies.agg(F.max("vft")).first()[0]
    lo, hi, left = 0.0, found or 1.0, budget
    path: list[tuple[float, float, int]] = []

    def place(vft, lo, span):
        return F.least(F.greatest(F.floor((vft - F.lit(lo)) / F.lit(span)), F.lit(0)), F.lit(n_ranges - 1)).cast("int")

    def inside(vft):
        out = F.lit(True)
        for lo, span, r in path:
            out = out & (place(vft, lo, span) == r)
        return out

    def before(vft):
        out = F.lit(False)
        for lo, span, r in reversed(path):
            at = place(vft, lo, span)
            out = (at < r) | ((at == r) & out)
        return out

    while True:
        span = (hi - lo) / n_ranges
        edge = copies.where(inside(F.col("vft")))
        sums = edge.groupBy(place(F.col("vft"), lo, span).alias("r")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()  # n_ranges rows at most
        cut = None
        for row in sorted(sums, key=lambda x: x["r"]):
            if row["size"] > left:
                cut = row
                break
            left -= row["size"]
        if cut is None:  # only at the first level: the budget covers all copies
            return lambda vft: F.lit(True)
        path.append((lo, span, cut["r"]))
        lo, hi = lo + span * cut["r"], lo + span * (cut["r"] + 1)
        if cut["n"] <= edge_rows or hi - lo < 1e-15:
            break
    order = ["vft", "source", "key", "doc_id", "size"]
    running = F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # The copy that crosses the budget is taken if half of it fits, so the total is off by half a document at most.
    within = copies.where(inside(F.col("vft"))).withColumn("upto", running).where(F.col("upto") - F.col("size") / 2 <= F.lit(left))
    last = within.agg(F.max(F.struct(*order)).alias("cut")).first()["cut"]
    kinds = {f.name: f.dataType for f in copies.schema.fields}

    def taken(vft):
        if last is None:
            return before(vft)
        key = F.struct(vft.alias("vft"), *[F.col(c) for c in order[1:]])
        bound = F.struct(*[F.lit(last[c]).cast(kinds[c]).alias(c) for c in order])
        return before(vft) | (inside(vft) & (key <= bound))

    return taken


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself: docs with each row as often as the mix takes it. Equal rows share what is taken of them."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    key, number = fresh(docs, "mix_key"), fresh(docs, "mix_copy")
    keyed = docs.withColumn(key, F.concat_ws(":", F.md5(text_or_empty("text")), part("doc_id"), part("source")))
    sizes = materialize(sized(keyed.select("doc_id", "source", F.col(key).alias("row_key"), "text")).drop("text"), "sizes")
    taken = mix(sizes, materialize(source_targets(sizes, weights, share, cap), "targets"))
    copies = taken.groupBy(F.col("row_key").alias(key)).agg(F.sum("copies").cast("int").alias(number)).where(F.col(number) > 0)
    # One key for both steps, so texts are shuffled once.
    once = keyed.dropDuplicates([key]).join(copies, key)
    return once.select(*map(quoted, docs.columns), F.explode(F.sequence(F.lit(1), F.col(number))).alias(number)).drop(number)


def op5_fair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = materialize(sized(docs.select("doc_id", "source", "text")).drop("text"), "sizes")
    return mix(sizes, materialize(source_targets(sizes), "targets")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS key FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap,
             (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS weight FROM per),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, level LIMIT 1) AS final),
t AS (SELECT source, source_size, least(cap, coalesce(final, 'infinity'::DOUBLE) * weight) AS target FROM l, f),
p AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT row_number() OVER () AS rid, * FROM p),
c AS (SELECT q.*, ((source_size * e + upto)::DOUBLE / target) AS vft FROM q, (SELECT unnest([0, 1]) AS e) WHERE size > 0 AND target > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY vft, source NULLS FIRST, key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS run FROM c),
k AS (SELECT rid, count(*) AS copies FROM g WHERE run - size / 2.0 <= (SELECT sum(target) FROM t) GROUP BY rid)
SELECT doc_id, size, source_size, target, (coalesce(copies, 0) * size)::BIGINT AS taken, source, coalesce(copies, 0)::INT AS copies
FROM q LEFT JOIN k USING (rid)
"""
