"""Phrase collocations from word-id suffix arrays.

Texts of one language are strung together into shards of about `SHARD_BYTES`, cut into words, and kept as arrays of word ids. Per shard
numpy sorts the suffixes by prefix doubling (by one word, two, four, eight) as deep as the longest phrase, and the
longest common prefixes of neighbours give the intervals of equal n-grams. A shard deals them out by hash to as many parts as there are
shuffle partitions, which are to grow with the input, in one compressed table a part, and a part adds the counts of equal phrases up. As a phrase is no more frequent than any part of it, this goes in rounds: words; pairs
of words that are frequent in the whole language; phrases of three and more whose pairs all are. After each round the shards get
those of their phrases back that are frequent, so what a round looks for is found exactly and nothing is broadcast but what
Spark measures to be small. A shard's lists are bounded by its words.

Arithmetic is in decimals of 38 digits.

Edge cases: null texts are empty; null languages are `und`; a text longer than a shard goes into several, each of which also sees the
next words of the text, so phrases across the cut count once; ties of score and count go by the phrase's bytes; repeated rows count
again; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, table, text_or_empty, trimmed

LONGEST, LEAST, TOP = 5, 100, 2000
SHARD_BYTES = 8 << 20
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: 0xFF is in no UTF-8 text: it stands for the end of a piece.
END = b"\xff"
FOLD = bytes.maketrans(bytes(range(65, 91)) + SEPARATORS + b"\t", bytes(range(97, 123)) + END * len(SEPARATORS) + b" ")
BLANK, WORD = re.compile(rb"[ \xff]"), re.compile(rb"[^ \xff]+|\xff")
SHARD_SCHEMA = "shard long, lang string, own long, ids binary, words array<struct<count:long,phrase:binary>>"


def cut(folded: bytes, size: int) -> Iterator[tuple[bytes, bytes]]:
    """(block, the next words of the same piece): blocks of about `size` bytes, cut at blanks or ends of pieces."""
    a = 0
    while a < len(folded):
        blank = BLANK.search(folded, a + size) if len(folded) - a > size else None
        b = blank.start() if blank else len(folded)
        ahead, at = [], b
        while blank and len(ahead) < LONGEST - 1 and (m := WORD.search(folded, at)) and m[0] != END:
            ahead.append(m[0])
            at = m.end()
        yield folded[a:b], b" ".join(ahead)
        a = b


def word_ids(folded: bytes):
    """(ids, words): the id of each word in order, 0 where a piece ends; words is an Arrow array by id."""
    import pyarrow as pa

    data = np.frombuffer(folded.replace(END, b" " + END + b" "), np.uint8)
    solid = data != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).view(np.int8)))
    offsets = np.concatenate([[0], np.cumsum(edge[1::2] - edge[::2])]).astype(np.int32)
    offsets = np.concatenate([[0, 1], offsets[1:] + 1]).astype(np.int32)  # the end itself goes first, so that its id is 0
    values = np.concatenate([np.frombuffer(END, np.uint8), data[solid]])
    words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy()[1:].astype(np.int32), coded.dictionary


def shards(docs: DataFrame, size: int = SHARD_BYTES) -> DataFrame:
    """One row a shard: its language, word ids, how many of them are its own, and its words with their count, in the order of their ids."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        next_id = TaskContext.get().partitionId() << 32

        def made(lang: str, folded: bytes, ahead: bytes) -> pa.RecordBatch:
            nonlocal next_id
            ids, words = word_ids(folded + b" " + ahead)
            own = len(ids) - len(ahead.split())
            count = np.bincount(ids[:own], minlength=len(words)).astype(np.int64)
            rows = pa.StructArray.from_arrays([pa.array(count[1:]), words[1:]], ["count", "phrase"])
            next_id += 1
            listed = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            return pa.RecordBatch.from_arrays([pa.array([next_id]), pa.array([lang]), pa.array([own]), pa.array([packed(ids)], pa.binary()), listed], names=["shard", "lang", "own", "ids", "words"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang, folded = lang.as_py(), text.as_py().translate(FOLD)
                if len(folded) > size:
                    for block, ahead in cut(folded, size):
                        yield made(lang, block, ahead)
                    continue
                held.setdefault(lang, []).append(folded)
                sizes[lang] = sizes.get(lang, 0) + len(folded) + 1
                # Of many languages the fullest goes first, so that all together stay within two shards.
                while sizes and (max(sizes.values()) >= size or sum(sizes.values()) >= 2 * size):
                    full = max(sizes, key=sizes.get)
                    del sizes[full]
                    yield made(full, END.join(held.pop(full)), b"")
        for lang, parts in held.items():
            yield made(lang, END.join(parts), b"")

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_or_empty("text").cast("binary").alias("text"))
    return rows.mapInArrow(trimmed(run), SHARD_SCHEMA)


def dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): the stable order of keys, and of each key the number of smaller distinct ones."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])]) if len(keys) else 0
    return order, rank


def intervals(ids: np.ndarray, reach: np.ndarray, own: int, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, counts) for n = low..high: each distinct n-gram with one of its places and its count; occurrences from place `own` on count zero.

    reach[p] is how many words from p on may belong to a phrase; only suffixes that reach `low` are sorted. ids has no negative number.
    """
    some = np.flatnonzero(reach >= low)
    if not len(some):
        return
    longest = min(high, int(reach.max()))
    # Prefix doubling: after each step ranks order suffixes by twice as many words. Only the last order is needed, over the suffixes of phrases.
    ranks, width = [ids.astype(np.int64)], 1
    while 2 * width < longest:
        rank = ranks[-1]
        after = np.zeros_like(rank)
        after[:-width] = rank[width:] + 1
        ranks.append(dense(rank * (int(after.max()) + 1) + after)[1])
        width *= 2
    rank = ranks[-1]
    after = np.append(rank, np.full(width, -1))[width:] + 1
    suffixes = some[np.argsort((rank * (int(after.max()) + 1) + after)[some], kind="stable")]
    # Common prefixes of neighbours: by falling powers of two, as the ranks tell which blocks are equal.
    a, b = suffixes[:-1], suffixes[1:]
    common = np.zeros(len(a), np.int64)
    steps = [(1 << k, r) for k, r in enumerate(ranks)]
    for wide, r in [steps[-1], *steps[::-1]]:
        pa_, pb = a + common, b + common
        inside = (pa_ + wide <= len(ids)) & (pb + wide <= len(ids))
        same = np.zeros(len(a), bool)
        same[inside] = r[pa_[inside]] == r[pb[inside]]
        common += wide * same
    for n in range(low, longest + 1):
        fits = reach[suffixes] >= n
        # Suffixes of equal n-words are neighbours, and all of them reach n or none does, as reach depends on the words alone within a piece.
        starts = np.flatnonzero(fits & np.concatenate([[True], common < n]))
        if len(starts):
            total = np.concatenate([[0], np.cumsum(fits & (suffixes < own))])
            ends = np.append(starts[1:], len(suffixes))
            yield n, suffixes[starts], total[ends] - total[starts]


def packed(numbers: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(1).compress(numbers.tobytes())


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def packed_table(rows: np.ndarray) -> bytes:
    """Columns of int64 (column by row), byte by byte of all numbers, as the high bytes are much alike."""
    return len(rows).to_bytes(1, "little") + packed(np.ascontiguousarray(np.ascontiguousarray(rows).view(np.uint8).reshape(-1, 8).T))


def unpacked_table(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpacked(blob[1:], np.uint8).reshape(8, -1).T).view(np.int64).reshape(blob[0], -1)


def part_of(words: np.ndarray, parts: int) -> np.ndarray:
    h = np.zeros(words.shape[1], np.uint64)
    for w in words:
        h = (h ^ w.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return (h % np.uint64(parts)).astype(np.int32)


def recoded(shards_: DataFrame, words: DataFrame) -> DataFrame:
    """(shard, own, ids, words): shards with their frequent words (shard, id, word) numbered from 1, every other word 0, and what these numbers stand for."""
    lists = words.groupBy("shard").agg(F.collect_list(F.struct("id", "word")).alias("found"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                shard, own, blob = (batch.column(c)[i].as_py() for c in range(3))
                ids, found = unpacked(blob, np.int32), batch.column(3)[i].values
                old, word = found.field(0).to_numpy(), found.field(1).to_numpy()
                number = np.zeros(max(int(ids.max()), int(old.max())) + 1, np.int32)
                number[old] = np.arange(1, len(old) + 1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([own]), pa.array([packed(number[ids])], pa.binary()), pa.array([packed(word)], pa.binary())], names=["shard", "own", "ids", "words"])

    rows = shards_.select("shard", "own", "ids").join(lists, "shard").select("shard", "own", "ids", "found")
    return rows.mapInArrow(trimmed(run), "shard long, own long, ids binary, words binary")


def counted(coded: DataFrame, found: DataFrame | None, part: int, high: int, deal: int) -> DataFrame:
    """Rows (dealt, shard, phrases), one for each shard and each of `deal` parts: a table of w1, w2, ..., count with the phrases of part + 1 to `high`
    words of the shard, 0 behind short ones, whose parts of `part` words are all in `found` (shard, found: tables of w1, ...); without it, of frequent words."""
    low, with_parts = part + 1, found is not None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                shard, own = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                ids, word = unpacked(batch.column(2)[i].as_py(), np.int32).astype(np.int64), np.concatenate([[0], unpacked(batch.column(3)[i].as_py(), np.int64)])
                frequent = ids > 0  # whether a part begins here
                if with_parts:
                    order, listed = np.argsort(word), np.concatenate([unpacked_table(x) for x in batch.column(4)[i].as_py()], axis=1)
                    number = [order[np.searchsorted(word, listed[c], sorter=order)] for c in range(part)]
                    # Parts are named word by word: the place of the name so far among those listed, then the next word.
                    code, of_part = ids[: len(ids) - part + 1], number[0]
                    for k in range(1, part):
                        names_, of_part = np.unique(of_part, return_inverse=True)
                        at = np.minimum(np.searchsorted(names_, code), len(names_) - 1)
                        code = np.where(names_[at] == code, at * len(word) + ids[k : len(ids) - part + 1 + k], -1)
                        of_part = of_part * len(word) + number[k]
                    frequent = np.append(np.isin(code, of_part), np.zeros(part - 1, bool))
                going, reach = np.ones(len(ids), bool), np.zeros(len(ids), np.int64)
                for k in range(high - part + 1):
                    going[: len(ids) - k] &= frequent[k:]
                    going[len(ids) - k :] = False
                    reach += going
                reach = np.where(reach > 0, reach + part - 1, 0)
                tables = []
                for n, places, counts in intervals(ids, reach, own, low, high):
                    tables.append(np.stack([*[word[ids[places + k]] if k < n else np.zeros(len(places), np.int64) for k in range(high)], counts.astype(np.int64)]))
                if not tables:
                    continue
                rows = np.concatenate(tables, axis=1)
                dealt = part_of(rows[:high], deal)
                order = np.lexsort((*rows[high - 1 :: -1], dealt))
                rows, dealt = rows[:, order], dealt[order]
                edge = np.r_[0, np.flatnonzero(np.diff(dealt)) + 1, len(dealt)]
                blobs = [packed_table(rows[:, a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(dealt[edge[:-1]]), pa.array([shard] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], names=["dealt", "shard", "phrases"])

    if with_parts:
        lists = found.groupBy("shard").agg(F.collect_list("found").alias("found"))
        coded = coded.join(lists, "shard").select("shard", "own", "ids", "words", "found")
    return coded.mapInArrow(trimmed(run), "dealt int, shard long, phrases binary")


def merged(dealt: DataFrame, parts: int, high: int, least: int, tell: bool) -> DataFrame:
    """Of each part the rows (w1, w2, ..., f) of phrases that occur `least` times, and if `tell` for each shard (shard, found), a table of those that it has."""
    names = ["shard", "found", *[f"w{k}" for k in range(1, high + 1)], "f"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        blobs = ((p.as_py(), s.as_py(), b.as_py()) for batch in batches for p, s, b in zip(*batch.columns, strict=True))
        for _, own in groupby(blobs, lambda r: r[0]):
            shards_, tables = zip(*((s, unpacked_table(b)) for _, s, b in own), strict=True)
            rows, shard = np.concatenate(tables, axis=1), np.repeat(np.array(shards_), [t.shape[1] for t in tables])
            del tables
            order = np.lexsort((shard, *rows[high - 1 :: -1]))
            rows, shard = rows[:, order], shard[order]
            starts = np.r_[0, np.flatnonzero((rows[:high, 1:] != rows[:high, :-1]).any(axis=0)) + 1]
            f = np.add.reduceat(rows[high], starts)
            often = f >= least
            some, n = starts[often], int(often.sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), *[pa.array(w[some]) for w in rows[:high]], pa.array(f[often])], names=names)
            told = np.repeat(often, np.diff(np.r_[starts, len(shard)])) & tell
            rows, shard = rows[:high, told], shard[told]
            order = np.argsort(shard, kind="stable")
            edge = np.r_[0, np.flatnonzero(np.diff(shard[order])) + 1, len(order)] if len(order) else np.zeros(1, np.int64)
            own = [packed_table(rows[:, order[a:b]]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard[order[edge[:-1]]], pa.int64()), pa.array(own, pa.binary()), *[pa.nulls(len(own), pa.int64())] * (high + 1)], names=names)

    rows = dealt.repartition(parts, "dealt").sortWithinPartitions("dealt")
    return rows.mapInArrow(trimmed(run), "shard long, found binary, " + ", ".join(f"{c} long" for c in names[2:]))


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, size: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f), (lang, n)): all phrases of up to `longest` words that occur `least` times in their language, and all words of each language.

    A shard's row of a word learns its frequency by a window over the word, which has one row a shard at most, and a part tells the shards
    which of their pairs are frequent: one shuffle both merges the counts and tells the shards. Words are named by the row number of one of their rows, pairs by two such names.
    """
    cutted = materialize(shards(docs, size), "shards")
    rows = cutted.select("shard", "lang", F.posexplode("words").alias("id", "w"))
    rows = rows.select("shard", "lang", (F.col("id") + 1).alias("id"), "w.phrase", "w.count").withColumn("row", F.monotonically_increasing_id() + 1)
    sizes = cutted.select("lang", F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + w["count"]).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    of_word = Window.partitionBy("lang", "phrase")
    known = rows.withColumn("f", F.sum("count").over(of_word)).withColumn("word", F.min("row").over(of_word)).where(F.col("f") >= least)
    known = materialize(known.drop("count"), "words")
    coded = materialize(recoded(cutted, known), "coded")
    parts = [f"w{k}" for k in range(1, longest + 1)]
    found, last, deal = None, None, shuffle_partitions(docs.sparkSession)
    # One round for pairs, one for all that is longer: a round for triples alone costs more than the rows that it saves.
    for part in range(1, min(longest, 3)):
        high = part + 1 if part < 2 else longest
        of = parts[:high]
        grams = materialize(merged(counted(coded, last, part, high, deal), deal, high, least, high < longest), "grams")
        last = grams.where("shard is not null").select("shard", "found")
        often = grams.where("f is not null").select(*of, "f")
        often = often.select(*[F.col(w) if w in of else F.lit(0).cast("long").alias(w) for w in parts], "f")
        found = often if found is None else found.unionByName(often)
    words = materialize(known.where("row = word").select("word", "lang", F.col("phrase").cast("string").alias("phrase"), "f"), "vocabulary")
    for k, w in enumerate(parts):
        one = words.select(F.col("word").alias(w), F.col("phrase").alias(f"p{k}"), *(["lang"] if not k else []))
        found = found.join(one, w, "left" if k > 1 else "inner")
    spelt = found.select("lang", F.concat_ws(" ", *[f"p{k}" for k in range(longest)]).alias("phrase"), "f")
    return materialize(spelt.unionByName(words.select("lang", "phrase", "f")), "frequent"), sizes


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, longest: int = LONGEST, size: int = SHARD_BYTES) -> DataFrame:
    """The best `top` phrases of each language by their weakest cut: lang, rank, phrase, a, l, r, n, score."""
    all_, sizes = frequent_phrases(docs, longest, least, size)
    words = F.split("phrase", " ")
    phrases = all_.where(F.contains("phrase", F.lit(" "))).select("lang", "phrase", F.col("f").alias("a"), words.alias("words"))
    # A longer phrase is at most as frequent as what it holds, so it is enough to look one word further.
    longer = phrases.where(F.size("words") > 2)
    inner = F.explode(F.array(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1)))
    inner = longer.select("lang", F.col("a").alias("of_longer"), inner.alias("w")).select("lang", "of_longer", F.array_join("w", " ").alias("phrase"))
    held = inner.groupBy("lang", "phrase").agg(F.max("of_longer").alias("of_longer"))
    kept = phrases.join(held, ["lang", "phrase"], "left").where("of_longer is null or of_longer < a")
    cuts = kept.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    side = lambda first, n: F.array_join(F.slice("words", first, n), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", side(F.lit(1), F.col("k")).alias("left"), side(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    lefts, rights = all_.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), all_.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    met = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).join(sizes, "lang")
    score = F.expr("cast(cast(1000 * cast(a as decimal(19, 0)) as decimal(38, 0)) * n div (cast(l as decimal(19, 0)) * r) as bigint)")
    worst = met.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return worst.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
sized AS (SELECT lang, w, unnest(range(1, least(len(w), 5) + 1)) AS k FROM worded),
grams AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
parts AS (SELECT lang, k, a, w, unnest(range(2, k)) AS m FROM c),
places AS (SELECT lang, a, m, w, unnest(range(1, k - m + 2)) AS i FROM parts),
dropped AS (SELECT DISTINCT p.lang, c.phrase FROM places p JOIN c ON c.lang = p.lang AND c.phrase = array_to_string(p.w[p.i:p.i + p.m - 1], ' ') AND 100 * p.a >= 100 * c.a),
kept AS (SELECT c.* FROM c ANTI JOIN dropped d ON c.lang = d.lang AND c.phrase = d.phrase),
cuts AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS cut FROM kept),
scored AS (SELECT x.lang, x.phrase, x.a, x.cut, l.f AS l, r.f AS r, n.n, ((1000::HUGEINT * x.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
           FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.cut], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.cut + 1:x.k], ' ')
           JOIN n ON n.lang = x.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM worst
QUALIFY rank <= 2000
"""
