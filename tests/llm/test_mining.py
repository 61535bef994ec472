"""Collocations, the prefix trie and SimHash: brute-force versions, SQL over odd tables, edge cases."""

import collections
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

from corpusloom.llm import collocations as C
from corpusloom.llm import prefixtrie as P
from corpusloom.llm import simhash as S

SF = "/root/testdata/sf0.001"


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())


def plain(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


# Collocations


@pytest.mark.parametrize("size", [300, 8 << 20])
def test_collocations_match_sql(spark, size):
    """Shards smaller than texts, blanks of all kinds, words that the shard's first row names, null texts and languages, repeated rows."""
    rnd = random.Random(3)
    words = ["a", "b", "c", "dd", "e f", "G", "é"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", " ", "\t", "  ", ".", ", ", "\n"]) for _ in range(n))
    rows = [(i, text(rnd.choice([0, 3, 50, 400])), rnd.choice(["x", "y", None]), 1) for i in range(200)]
    rows += [(900, text(9000), "x", 1), (901, None, "y", 1), (902, "a b " * 2000, "z", 1), (903, "", None, 1), (903, "a b", "x", 1), (903, "a b", "x", 1), (None, "w" * 5000, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, f int").repartition(4)
    documents = pd.DataFrame([r[:3] for r in rows], columns=["doc_id", "text", "lang"])
    assert plain(C.collocations(df, size=size)) == by_sql(C.OP11_SQL, documents=documents)


def test_collocations_rows_by_shard_and_part(spark):
    """Phrases go from shards to parts in one row for each two of them, however many there are; parts add them up exactly."""
    words = np.random.default_rng(3).zipf(1.3, 30_000) % 300
    df = spark.createDataFrame([(" ".join(f"w{w}" for w in words[a : a + 500]), "en") for a in range(0, len(words), 500)], "text string, lang string").coalesce(1)
    made, counted = [], C.counted
    try:
        C.counted = lambda *a: made.append(counted(*a)) or made[-1]
        got = {r["phrase"]: r["f"] for r in C.frequent_phrases(df, least=3, size=20_000)[0].collect()}
        shards, deal = C.shards(df, 20_000).count(), C.shuffle_partitions(spark)
        rows = [d.count() for d in made]
    finally:
        C.counted = counted
    want = {}
    for a in range(0, len(words), 500):
        text = [f"w{w}" for w in words[a : a + 500]]
        for n in range(1, 6):
            for i in range(len(text) - n + 1):
                p = " ".join(text[i : i + n])
                want[p] = want.get(p, 0) + 1
    assert shards > 3 and len(rows) == 2 and all(0 < r <= shards * deal for r in rows)
    assert got == {p: f for p, f in want.items() if f >= 3}


def test_collocations_of_nothing(spark):
    assert C.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_intervals_count_ngrams():
    rnd = np.random.default_rng(1)
    ids = rnd.integers(0, 4, 3000)
    ends = np.flatnonzero(ids == 0)
    reach = np.array([min(5, (ends[ends >= p][0] if (ends >= p).any() else len(ids)) - p) for p in range(len(ids))])
    got = {(n, tuple(ids[p : p + n])): c for n, at, count in C.intervals(ids, reach, 2900, 2, 5) for p, c in zip(at, count, strict=True) if c}
    want = collections.Counter((n, tuple(ids[p : p + n])) for n in range(2, 6) for p in range(2900) if reach[p] >= n)
    assert got == want


# The trie


def conversations(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS depth", "'x' AS path", "2 AS words")
    return df.repartition(3), pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})


def test_trie_matches_sql(spark):
    """Shared heads, chains longer than others, null turns, roles and texts, ties, repeated rows, negative ids, lost conversations."""
    rnd = random.Random(7)
    rows = []
    for c in [*range(-25, 60), 400]:
        for t in range(rnd.choice([0, 1, 2, 3, 9])):
            rows.append((c, rnd.choice([t, t, None]), rnd.choice(["user", "assistant", None]), rnd.choice(["a b", "", None, "A\tb  c"])))
    rows += [(7, 1, "user", "same")] * 3 + [(11, t, "user", f"t{t}") for t in range(200)] + [(13, t, "user", f"t{t}") for t in range(150)]
    df, table = conversations(spark, rows)
    assert plain(P.prefix_trie(df)) == by_sql(P.OP12_SQL, conversations=table)


def test_trie_in_short_pieces(spark, monkeypatch):
    """Conversations, paths and running names over many pieces."""
    monkeypatch.setattr(P, "PIECE", 4)
    rows = [(c, t, "user", f"{min(t, c)} {t}") for c in range(20, 33) for t in range(c)]
    df, table = conversations(spark, rows)
    assert plain(P.prefix_trie(df)) == by_sql(P.OP12_SQL, conversations=table)


def test_trie_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert P.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    assert P.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], schema)).count() == 0
    df, table = conversations(spark, [(3, 0, None, None)])
    assert plain(P.prefix_trie(df)) == by_sql(P.OP12_SQL, conversations=table)


# SimHash


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    """Index of the smallest member of each print's component, all pairs compared."""
    at, label = np.array(prints, np.uint64), list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(at)):
        for j in np.flatnonzero(np.bitwise_count(at[i + 1 :] ^ at[i]) <= 3):
            a, b = sorted((find(i), find(i + 1 + int(j))))
            label[b] = a
    return [find(i) for i in range(len(at))]


def test_simhash_matches_brute_force(spark):
    rows = sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()))
    prints = [slow_print(t) for _, t in rows]
    want = {(i, f"{p:016x}", rows[c][0]) for (i, _), p, c in zip(rows, prints, slow_components(prints), strict=True)}
    assert {tuple(r) for r in S.op13_simhash(spark, SF).collect()} == want


@pytest.mark.parametrize("most", [8, 300, S.SLOT])
def test_links_span_a_dense_family(spark, most):
    """A family around one centre, dealt again where slots are too full: the components of all pairs, and only true links."""
    rnd = random.Random(1)
    centre, prints = rnd.getrandbits(64), {rnd.getrandbits(64) for _ in range(100)}
    for _ in range(1200):
        x = centre
        for _ in range(rnd.randrange(7)):
            x ^= 1 << rnd.randrange(64)
        prints.add(x)
    prints = sorted(prints)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    links = S.links(spark.createDataFrame([(p,) for p in signed], "fp long"), most).collect()
    place, label = {p: k for k, p in enumerate(signed)}, list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in links:
        assert bin(prints[place[r["a"]]] ^ prints[place[r["b"]]]).count("1") <= 3
        a, b = sorted((find(place[r["a"]]), find(place[r["b"]])))
        label[b] = a
    assert [find(i) for i in range(len(prints))] == slow_components(prints)


def test_simhash_edges(spark):
    long_ = " ".join(f"w{k % 977}" for k in range(120_000))
    texts = [(5, None), (3, ""), (4, " \n"), (9, "One two"), (8, "one TWO"), (8, "one two"), (None, "one two"), (1, "é ß 日本"), (2, long_), (7, long_.upper())]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, fp int, label string")
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in S.simhash_components(df).collect()}
    signed = lambda t: int(np.uint64(slow_print(t)).view(np.int64))
    assert signed(long_) == signed(long_.upper()) and got[2, signed(long_)] == got[7, signed(long_)] == 2
    assert [got[i, 0] for i in (3, 4, 5)] == [3, 3, 3] and got[9, signed("one two")] == got[None, signed("one two")] == 8
    assert S.simhash_components(df).count() == len(texts) and S.simhash_components(df.limit(0)).count() == 0
