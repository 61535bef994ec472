"""The trie of conversation prefixes, summed over subtrees by heavy-path decomposition.

Every distinct sequence of first d turns is a node. A turn has a 128-bit hash of its place, role and text, and a prefix is named by its
depth and the XOR of the hashes of its turns, so names come from running sums and a conversation of any length is cut into pieces of
`PIECE` turns that are summed apart (two of n prefixes share a name with a chance of n^2 / 2^129, unless texts are made to collide).

The heavy child of a node is the one of most members (ties: that of the smallest conversation), so every other, light child has at
most half of its parent's members, and a path to the root has at most log2 of all conversations light edges. Heavy edges form
paths, each of which ends in a childless node and is spelt by that node's smallest member: the path's nodes are that
conversation's prefixes from the deepest light one on. Path totals go up the light edges in logarithmic rounds, each over paths
alone; the totals are attached to the parents, and suffix sums along the path arrays, which numpy makes piece by piece, give the sums of
every subtree. No row ever holds a path, and no two nodes are compared.

Member lists are hashed in order without gathering them: ids are range-sorted by node, each range strings its own together, and the
strings of a node pass through SHA-256 one after another.

Edge cases: a null turn comes first; rows that share a turn are ordered by role and text, and repeated rows are turns of their own; null
role or text is the empty string; rows without conv_id are left out; an empty table gives an empty result, without a root; extra columns are
ignored. One turn must fit a row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, trimmed

PIECE = 4096
WORDS = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "ka", "kb"]


def own_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words): turns with their place in their conversation, from 1. Order is by range partitions, so a long conversation lies in several."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    words = F.size(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))).cast("long")
    # Row ids ascend within a range; a conversation's rows of one range are in a row.
    d = materialize(rows.select("conv_id", digest.alias("digest"), words.alias("words"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "turns")
    stretch = d.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretch = stretch.select("conv_id", "part", "first", before.alias("before"))
    return d.join(stretch, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"), "digest", "words")


def rebuilt(conversations: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """((conv_id, len), (conv_id, len, pos, digest, words)): conversation c with the first h turns of c - c % every for its own first h; h = crc32(c) % heads."""
    own = materialize(own_turns(conversations), "own")
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h")
    base = sizes.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h).join(base, "base", "left")
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = materialize(convs.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "convs")
    first = own.where((F.col("conv_id") % every == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "base")
    head = convs.where("taken > 0").join(first, "base").where("pos <= taken").select("conv_id", "len", "pos", "digest", "words")
    rest = own.join(convs, "conv_id").where("pos > h").select("conv_id", "len", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), "digest", "words")
    return convs.select("conv_id", "len"), head.unionByName(rest)


def piece_of(depth: str) -> Column:
    return F.floor(F.col(depth) / PIECE).cast("long")


def steps(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, len, depth, ka, kb, pa, pb, words): a row for each prefix of each conversation, the empty one included; pa, pb name its parent."""
    hashed = turns.select("conv_id", "len", F.col("pos").alias("depth"), F.xxhash64("digest", "pos").alias("a"), F.xxhash64("pos", "digest", F.lit(1)).alias("b"), "words", piece_of("pos").alias("piece"))
    run = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = hashed.select("*", F.bit_xor("a").over(run).alias("ra"), F.bit_xor("b").over(run).alias("rb"))
    pieces = hashed.where(F.col("len") >= PIECE).groupBy("conv_id", "piece").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = pieces.select("conv_id", "piece", F.bit_xor("a").over(before).alias("ca"), F.bit_xor("b").over(before).alias("cb"))
    zero = F.lit(0).cast("long")
    ka, kb = F.col("ra").bitwiseXOR(F.coalesce("ca", zero)), F.col("rb").bitwiseXOR(F.coalesce("cb", zero))
    named = summed.join(carry, ["conv_id", "piece"], "left").select("conv_id", "len", "depth", ka.alias("ka"), kb.alias("kb"), ka.bitwiseXOR(F.col("a")).alias("pa"), kb.bitwiseXOR(F.col("b")).alias("pb"), "words")
    none = F.lit(None).cast("long")
    roots = convs.select("conv_id", "len", zero.alias("depth"), zero.alias("ka"), zero.alias("kb"), none.alias("pa"), none.alias("pb"), zero.alias("words"))
    return materialize(named.unionByName(roots), "steps")


def parent_key() -> list[Column]:
    return [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")]


def nodes_of(steps_: DataFrame) -> DataFrame:
    """A row for each node: its name, smallest member, members, children, and whether it is light, i.e. not its parent's heavy child."""
    nodes = steps_.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.first("words").alias("words"))
    nodes = materialize(nodes, "nodes")
    kids = nodes.where("depth > 0").select(*parent_key(), "n_convs", "conv_id").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"), F.min(F.struct(-F.col("n_convs"), "conv_id")).alias("heavy"))
    parents = nodes.select(*KEY, "conv_id").join(kids, KEY, "left").select(*KEY, F.col("conv_id").alias("parent_conv_id"), F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.col("heavy.conv_id").alias("heavy"))
    parents = materialize(parents, "parents")
    of = parents.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), "parent_conv_id", "heavy")
    light = F.col("heavy").isNull() | (F.col("heavy") != F.col("conv_id"))
    placed = nodes.join(of, ["depth", "pa", "pb"], "left").join(parents.select(*KEY, "n_children"), KEY)
    return materialize(placed.select(*KEY, "pa", "pb", "conv_id", "parent_conv_id", "n_convs", "n_children", light.alias("light"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")), "placed")


def heavy_paths(steps_: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes with their path, named by the conversation that spells it, and whether they are its top."""
    ends = nodes.where("n_children = 0").select(F.col("conv_id").alias("path"))
    spelt = steps_.select(F.col("conv_id").alias("path"), *KEY).join(ends, "path", "left_semi")
    spelt = materialize(spelt.join(nodes, KEY), "spelt")
    tops = spelt.where("light").groupBy("path").agg(F.max("depth").alias("top"))
    on_path = spelt.join(tops, "path").where("depth >= top")
    return materialize(on_path.withColumn("is_top", F.col("depth") == F.col("top")).drop("top", "light"), "paths")


def path_totals(paths: DataFrame, values: list[str]) -> DataFrame:
    """(path, up_path, up_depth, values): of every path the place that it hangs from and the sums over the whole subtree of its top."""
    own = paths.groupBy("path").agg(*[F.sum(v).alias(v) for v in values])
    place = paths.select(*KEY, F.col("path").alias("up_path"), F.col("depth").alias("up_depth"))
    hangs = paths.where("is_top").select("path", *parent_key()).join(place, KEY, "left").select("path", "up_path", "up_depth")
    hangs = materialize(hangs.join(own, "path"), "hangs")
    up = hangs.where("up_path is not null").select("path", "up_path")
    message = hangs.select("path", *values)
    parts = [message]
    while True:
        sent = message.join(up, "path").groupBy("up_path").agg(*[F.sum(v).alias(v) for v in values])
        message = materialize(sent.withColumnRenamed("up_path", "path"), "message")
        if not message.limit(1).count():
            break
        parts.append(message)
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    total = total.groupBy("path").agg(*[F.sum(v).alias(v) for v in values])
    return materialize(hangs.select("path", "up_path", "up_depth").join(total, "path"), "totals")


def suffix_sums(rows: DataFrame, values: list[str]) -> DataFrame:
    """rows (path, depth, values) with each value summed over the path from its depth on."""
    n = len(values)
    cut = rows.withColumn("piece", piece_of("depth"))
    arrays = cut.groupBy("path", "piece").agg(F.array_sort(F.collect_list(F.struct("depth", *values))).alias("at"))
    sums = cut.groupBy("path", "piece").agg(*[F.sum(v).alias(v) for v in values])
    after = Window.partitionBy("path").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    later = sums.select("path", "piece", *[F.coalesce(F.sum(v).over(after), F.lit(0)).alias(f"later_{v}") for v in values])
    arrays = arrays.join(later, ["path", "piece"]).select("path", "at", *[f"later_{v}" for v in values])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            size = lists.value_lengths().to_numpy()
            end = np.cumsum(size)
            fields = [flat.field(i).to_numpy() for i in range(n + 1)]
            out = []
            for i in range(n):
                v = fields[i + 1]
                run_ = np.cumsum(v[::-1])[::-1]  # over all arrays of the batch; what follows an array's end is taken off
                rest = np.append(run_, 0)[end]
                out.append(run_ + np.repeat(batch.column(2 + i).to_numpy() - rest, size))
            path = np.repeat(batch.column(0).to_numpy(), size)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in [path, fields[0], *out]], names=["path", "depth", *values])

    return arrays.mapInArrow(trimmed(run), "path long, depth long, " + ", ".join(f"{v} long" for v in values))


def digests(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) of members (node, conv_id): the hash of a node's ids, ascending and comma-joined."""
    names = [f.name for f in members.schema.fields if f.name != "conv_id"]
    kinds = ", ".join(f"{c} long" for c in names)
    ranges = members.repartitionByRange(*names, "conv_id").withColumn("part", F.spark_partition_id())
    strung = ranges.groupBy(*names, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    strung = materialize(strung, "members")

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        now, h = None, None
        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(len(names))], strict=True))
            done = []
            for key, ids in zip(keys, batch.column(len(names)).to_pylist(), strict=True):
                if key == now:
                    h.update(b",")
                else:
                    if h:
                        done.append((*now, h.hexdigest()))
                    now, h = key, hashlib.sha256()
                h.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=[*names, "ends_sha256"])
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*now, h.hexdigest())], names=[*names, "ends_sha256"])

    rows = strung.repartition(*names).sortWithinPartitions(*names, "part").select(*names, "ids")
    return rows.mapInArrow(trimmed(run), f"{kinds}, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations."""
    convs, turns = rebuilt(conversations)
    walked = steps(convs, turns)
    paths = heavy_paths(walked, nodes_of(walked))
    values = ["saved", "leaves"]
    valued = paths.withColumn("leaves", (F.col("n_children") == 0).cast("long"))
    totals = path_totals(valued, values)
    hung = totals.where("up_path is not null").groupBy(F.col("up_path").alias("path"), F.col("up_depth").alias("depth")).agg(*[F.sum(v).alias(f"hung_{v}") for v in values])
    with_light = valued.join(hung, ["path", "depth"], "left").select("path", "depth", *[(F.col(v) + F.coalesce(f"hung_{v}", F.lit(0))).alias(v) for v in values])
    sums = suffix_sums(with_light, values)
    ends = digests(walked.where("depth = len").select(*KEY, "conv_id"))
    whole = paths.drop("saved").join(sums, ["path", "depth"]).join(ends, KEY, "left")
    nobody = F.sha2(F.lit(""), 256)
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", nobody).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
codes AS (SELECT conv_id, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i::BIGINT, 1))::BIGINT) AS s FROM ids),
crc AS (SELECT conv_id, xor(list_reduce(s, lambda a, x: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(a, x)), 4294967295), 4294967295) % 4 AS h FROM codes),
own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
               coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
head AS (SELECT c.conv_id, c.h, o.pos, o.role, o.text FROM crc c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.pos <= c.h),
taken AS (SELECT c.conv_id, c.h, count(d.pos) AS k FROM crc c LEFT JOIN head d USING (conv_id) GROUP BY ALL),
rebuilt AS (SELECT conv_id, pos, role, text FROM head UNION ALL
            SELECT o.conv_id, t.k + o.pos - t.h, o.role, o.text FROM own o JOIN taken t USING (conv_id) WHERE o.pos > t.h),
spelt AS (SELECT conv_id, pos AS depth, string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix,
                 len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM rebuilt
          UNION ALL SELECT conv_id, 0, '', 0 FROM crc),
steps AS (SELECT conv_id, depth, sha256(prefix) AS k, CASE WHEN depth > 0 THEN sha256(substr(prefix, 1, 32 * (depth - 1))) END AS up, words,
                 depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM spelt),
nodes AS (SELECT depth, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
                 sha256(coalesce(string_agg(CASE WHEN last THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM steps GROUP BY depth, k),
kids AS (SELECT up AS k, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT s.k, sum(n.saved) AS saved, count(*) FILTER (WHERE n.k NOT IN (SELECT k FROM kids)) AS leaves
          FROM nodes n JOIN steps s ON s.conv_id = n.conv_id AND s.depth <= n.depth GROUP BY s.k)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
       below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below USING (k) LEFT JOIN kids USING (k) LEFT JOIN nodes p ON p.k = n.up
"""
