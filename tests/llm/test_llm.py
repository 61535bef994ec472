"""The training-data operators: edge cases, and brute-force versions where SQL cannot state them."""

import glob
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bitsliced, chat, components, decontaminate, langid, mixing, neardup, pii, registry, sharding, substrings, suffixsort, toxicity

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, node string, score double, label int, key string"


def frame(spark, texts, ids=None):
    """Documents with clashing extra columns."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", None, 7, "n", 0.5, 1, "k") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOC)


rnd = random.Random(5)
VOCAB = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8))) for _ in range(300)]


def prose(n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


LONG = prose(30_000)
ODD = [None, "", " \n", "a", "é ß 日本 😀", LONG, prose(80), "x" * 5000]


@pytest.fixture(scope="module")
def odd(spark):
    texts = ODD + [ODD[6], ODD[6], ODD[5]]
    return frame(spark, texts, [*range(8), 8, 8, None]).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(documents):
    return [(r["doc_id"], r["text"]) for r in documents.collect()]


# Every query runs; those with SQL match it


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = registry.QUERIES[name](spark, SF)
    cursor = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    cols = sorted(names)
    assert cols == sorted(df.columns)
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(str(r[names.index(c)]) for c in cols) for r in cursor.fetchall())


# 1 Decontamination


def test_decontamination(spark):
    items = [(k, prose(40)) for k in range(6)] + [(6, ""), (7, None), (8, "two words")]
    edited = items[1][1].split()
    for i in range(3, 40, 8):
        edited[i] = "changed"
    texts = [f"{prose(50)} {items[0][1].upper()} {prose(50)}", f"{prose(30)} {' '.join(edited)}", prose(200), " ".join(items[2][1].split()[:8]) + " " + prose(80), *ODD]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(frame(spark, texts), bench).collect()}
    assert got[0, 0] == 1.0 and 0.5 <= got[1, 1] < 1
    assert {k for k in got if k[1] < 6} == {(0, 0), (1, 1)}


def test_common_item_still_seeds(spark):
    item = prose(30)
    texts = [f"{prose(20)} {item}" for _ in range(60)] + [prose(60) for _ in range(40)]
    got = decontaminate.contaminated(frame(spark, texts), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == set(range(60))


def brute_score(text, item):
    """Best local alignment of two lists of words."""
    best, before = 0, [0] * (len(item) + 1)
    for x in text:
        now = [0]
        for j, y in enumerate(item):
            now.append(max(0, before[j] + (1 if x == y else -1), before[j + 1] - 1, now[j] - 1))
        best, before = max(best, *now), now
    return best


@pytest.mark.parametrize("exact", [0, 2])
@pytest.mark.parametrize("every", [5, 6, 7])
def test_edited_copies_in_many_documents(spark, every, exact):
    """No edited copy is lost where many documents share its n-grams and those that the edits broke occur nowhere or in exact copies only."""
    item = [f"w{i}" for i in range(40)]
    texts = [f"{prose(30)} {' '.join(w if (i + 1) % every else 'changed' for i, w in enumerate(item))} {prose(30)}" for _ in range(20)]
    texts += [f"{prose(20)} {' '.join(item)}"] * exact + [prose(90) for _ in range(50)] + ["w3 w4 w5 w6 " + prose(60)]
    want = {(d, s / 40) for d, t in enumerate(texts) if (s := brute_score(t.split(), item)) >= 20}
    got = decontaminate.contaminated(frame(spark, texts), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert {(r["doc_id"], r["score"]) for r in got.collect()} == want and len(want) == 20 + exact


def test_alignment_against_cells():
    def cells(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        return h.max()

    r = np.random.default_rng(2)
    for _ in range(50):
        w, t = r.integers(0, 4, r.integers(1, 30)), r.integers(0, 4, r.integers(1, 20))
        assert decontaminate.align(w[None, :], t[None, :])[0] == cells(w, t)


def test_very_long_texts(spark):
    """Windows of more than 32,767 words: a match at the end is found, and a long clean text stays clean."""
    item = [f"w{i}" for i in range(40)]
    window = np.full((2, 100_000), -1, np.int64)
    window[1, 99_000:99_040] = np.arange(40)
    assert decontaminate.align(window, np.arange(40)[None, :].repeat(2, axis=0)).tolist() == [0, 40]
    clean = (item[10:14] + ["other"] * 36) * 2500
    texts = [" ".join(clean), " ".join(clean + item), " ".join([*clean, *item, "end"] + clean)]
    got = decontaminate.contaminated(frame(spark, texts), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert sorted((r["doc_id"], r["score"]) for r in got.collect()) == [(1, 1.0), (2, 1.0)]


def test_recall_by_edit_rate(spark):
    """All pairs by brute force: of the copies that score the threshold or more, 0.9 are found at each rate of edited words."""
    items = [prose(40).split() for _ in range(4)]
    texts, rates = [], (0.0, 0.05, 0.1, 0.15, 0.2)
    for rate in rates:
        for k in range(40):
            texts.append(prose(15).split() + [w if rnd.random() >= rate else "changed" for w in items[k % 4]] + prose(15).split())
    want = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if brute_score(t, item) >= 20}
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, [" ".join(t) for t in texts]), bench).collect()}
    assert got <= want
    for k in range(len(rates)):
        own = {p for p in want if p[0] // 40 == k}
        assert len(got & own) >= 0.9 * len(own) and len(own) > 20


def test_ids_stay_whole(spark):
    """Ids beyond 2**53 beside a null id, in every operator that hands texts to Python."""
    item = prose(30)
    big = 2**60 + 1
    docs = frame(spark, [f"{prose(5)} {item}", item, item, prose(40)], [big, None, big + 1, big + 2])
    bench = spark.createDataFrame([(7, item), (None, prose(20)), (8, "words")], "item_id long, text string")
    assert {(r["doc_id"], r["score"]) for r in decontaminate.contaminated(docs, bench).collect()} == {(big, 1.0), (None, 1.0), (big + 1, 1.0)}
    ids = {big, None, big + 1, big + 2}
    assert {r["doc_id"] for r in toxicity.scored(docs, toxicity.Model(b"", b"", 0.1), docs.columns, "s").collect()} == ids
    assert {r["doc_id"] for r in langid.labelled(docs, None).collect()} == ids
    assert {r["doc_id"] for r in neardup.classes(docs).collect()} == ids


def test_items_of_few_words_and_without_id(spark):
    bench = spark.createDataFrame([(1, "common"), (None, "null id item of six words")], "item_id long, text string")
    texts = ["a common word", "Common!", "the null id item of six words here", prose(50)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, texts), bench).collect()}
    assert got == {(1, 1), (2, None)}


def test_decontamination_empty(spark, empty):
    bench = spark.createDataFrame([(1, prose(9))], "item_id long, text string")
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(frame(spark, ["a b"]), bench.limit(0)).count() == 0


# 2 Toxicity


def test_toxicity_learns(spark, odd, empty):
    bad = ["scumbag", "wretched", "despicable"]
    texts, marks = [], []
    for i in range(600):
        ws = prose(60).split()
        if i % 4 == 0:
            for j in range(0, 60, 12):
                ws[j] = rnd.choice(bad)
        texts.append(" ".join(ws))
        marks.append(int(i % 4 == 0))
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)], "doc_id long, toxic int")
    model = toxicity.train(*toxicity.sample(docs, labels))
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model, ["doc_id"]).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(marks[i]) for i in held]) > 0.9
    scores = [r["score"] for r in toxicity.scored(odd, model, odd.columns, "_s").select(F.col("_s").alias("score")).collect()]
    assert len(scores) == 11 and all(0 <= s <= 1 for s in scores)
    assert toxicity.scored(empty, model, ["doc_id"]).count() == 0
    none = toxicity.train(*toxicity.sample(docs, labels.limit(0)))
    assert {r["score"] for r in toxicity.scored(docs.limit(5), none, ["doc_id"]).collect()} == {0.0}


# 3 Repeated byte strings


def brute_repeats(docs, n=50):
    first = {}
    for d, t in docs:
        for i in range(len(t) - n + 1):
            w = t[i : i + n]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if first[t[i : i + n]] < d:
                gone[i : i + n] = b"\x01" * n
        runs = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def test_repeats_on_documents(spark, documents, rows):
    got = sorted(tuple(r) for r in substrings.remove_repeats(documents).collect())
    assert got == brute_repeats([(d, (t or "").encode()) for d, t in rows])


def test_repeats_planted(spark, empty):
    p, q = prose(20)[:50], prose(40)[:90]
    texts = [p, q + "é" * 40, "1" + p + "2", p[:49], "z" * 300, "z" * 60, q[20:75] + q, p, None, "", prose(10) + q, q[:50] + q[40:]]
    got = sorted(tuple(r) for r in substrings.remove_repeats(frame(spark, texts)).collect())
    assert got == brute_repeats([(i, (t or "").encode()) for i, t in enumerate(texts)])
    assert substrings.remove_repeats(empty).count() == 0


def test_repeats_edge_ids(spark):
    t = prose(30)
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in substrings.remove_repeats(frame(spark, [t, t, t], [5, 5, None])).collect())
    n = len(t.encode())
    assert got == [("5", 0), ("5", 0), ("None", n)]


def common_prefix(a, b, most):
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y or k == most), min(len(a), len(b), most))


@pytest.mark.parametrize("block", [4, 1 << 15])
def test_suffix_array(monkeypatch, block):
    """Places and common prefixes, with queues that spill to files and blocks of a few tuples."""
    monkeypatch.setattr(suffixsort, "BLOCK", block)
    r = np.random.default_rng(4)
    for _ in range(60):
        t = r.integers(0, 1 + r.integers(1, 5), r.integers(1, 120)).astype(np.uint8) + 97
        if r.random() < 0.4:
            t = np.tile(t[: max(1, len(t) // 6)], 7)
        b, depth = t.tobytes(), int(r.choice([3, 50]))
        order, shared = suffixsort.suffix_array(t, depth, memory=int(r.choice([0, 200, 1 << 20])))
        want = sorted(range(len(b)), key=lambda i: b[i:])
        assert order.tolist() == want
        assert shared.tolist() == [0] + [common_prefix(b[i:], b[j:], depth) for i, j in zip(want, want[1:], strict=False)]


def test_sort_larger_than_memory(tmp_path):
    """A shard whose queues take over ten times the memory: the tuples in memory stay within it, and the result is that of a sort in memory."""
    words = prose(40_000).encode()
    text = np.frombuffer(words, np.uint8)
    memory = 24 * len(text) // 12
    space, most = suffixsort.Space(memory, str(tmp_path)), 0
    push = suffixsort.Queue.push

    def watched(self, rows, in_order=False):
        nonlocal most
        push(self, rows, in_order)
        most = max(most, sum((len(r) - a) * 24 for r, a in self.near))

    suffixsort.Queue.push = watched
    try:
        order, shared = suffixsort.sort(text, 50, space)
    finally:
        suffixsort.Queue.push = push
    again = suffixsort.suffix_array(text, 50, memory=1 << 30)
    assert (order == again[0]).all() and (shared == again[1]).all()
    assert most <= memory and space.on_disk > 10 * memory


def test_recursion_ends_in_memory(monkeypatch):
    """A string of names that fits the memory is sorted there: 64 KB of prose take one level of queues, with little memory several, and both agree."""
    text, levels = np.frombuffer(prose(20_000).encode()[: 1 << 16], np.uint8), []
    types = suffixsort.types
    monkeypatch.setattr(suffixsort, "types", lambda *a: levels.append(len(a[0])) or types(*a))
    order, shared = suffixsort.suffix_array(text, 50, memory=64 << 20)
    assert levels == [1 << 16]
    again = suffixsort.suffix_array(text, 50, memory=1 << 10)
    assert len(levels) > 3 and (order == again[0]).all() and (shared == again[1]).all()


def test_shard_in_parts(spark):
    """A shard is sorted in parts by key, only of stretches that may share a string, with the result of the whole."""
    joined = [b"a" * 49 + b"bc", b"x" * 30 + b"b" * 25, b"c" + b"a" * 49 + b"b"]
    assert substrings.may_share(np.frombuffer(b"".join(joined), np.uint8), np.array([len(x) for x in joined]), 50).tolist() == [True, False, True]
    words = prose(3000).split()
    docs = [(i, " ".join(words[30 * i % 2000 : 30 * i % 2000 + 80] + [str(i)] + words[7 * i : 7 * i + 40])) for i in range(60)]
    blobs = {}
    for i, t in docs:
        data = t.encode()
        for a, b, k in zip(*substrings.Keys().runs(np.frombuffer(data, np.uint8)), strict=True):
            blobs.setdefault(data[a : b + 49], [int(k.view(np.int64)), i, i])[2] = i
    blob = substrings.pack(b"".join(blobs), np.array([len(x) for x in blobs], np.int64), np.array(list(blobs.values()), np.int64))
    rows = spark.createDataFrame([(0, blob, None, 0, None, None, None)], f"shard int, blob binary, {substrings.PLACES}")
    found = [
        sorted((r["h"], r["l"], p) for r in substrings.repeated(rows, 1, 50, memory).collect() for x in zip(r["lows"], r["begins"], r["ends"], strict=True) for p in [(x[0], y) for y in range(x[1], x[2])])
        for memory in (1 << 16, 1 << 26)
    ]
    assert found[0] == found[1] and len(found[0]) > 100


def test_repeats_large_ids(spark):
    """doc_ids beyond 2**53 that differ in their last bit only stay apart."""
    p, big = prose(30), 1 << 60
    texts = [p + " one" * 9, "two " * 9 + p, p[3:80], None]
    ids = [big + 1, big, big + 2, None]
    got = sorted(tuple(r) for r in substrings.remove_repeats(frame(spark, texts[:3], ids[:3])).collect())
    assert got == brute_repeats([(i, t.encode()) for i, t in zip(ids[:3], texts[:3], strict=True)])


# 4 Language


def test_language(spark, documents, empty):
    field = langid.fit(langid.sample(documents))
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    got = {r["doc_id"]: r for r in langid.labelled(documents, field).collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert np.mean([got[d]["lang_pred"] == truth[d] for d in held]) > 0.95
    odd = frame(spark, [None, "", "12 !", "a", "日本"])
    out = {r["doc_id"]: (r["lang_pred"], r["n_words"]) for r in langid.labelled(odd, field).collect()}
    assert [out[i][0] for i in range(3)] == ["und"] * 3 and out[3][0] != "und" and out[4][1] == 1
    assert langid.labelled(empty, field).count() == 0
    assert langid.labelled(odd, None).where("lang_pred = 'und'").count() == 5


def test_dotted_capital_i(spark):
    """A dotted capital I is one letter of its word, in training and in scoring."""
    rows = [("tr", f"İstanbul İzmir {prose(20)} İĞDIR") for _ in range(30)] + [("en", prose(30)) for _ in range(30)]
    field = langid.fit(rows)
    out = langid.labelled(frame(spark, ["İstanbul İzmir"]), field).first()
    assert out["n_words"] == 2 and out["lang_pred"] == "tr"
    assert langid.labelled(frame(spark, ["İstanbul İzmir"]), None).first()["n_words"] == 2


def test_code_switching(spark, documents):
    field = langid.fit(langid.sample(documents))
    by = {r["lang"]: r["text"] for r in documents.where("n_chars > 1500").collect()}
    text = " ".join(by[x][:400] for x in ("en", "de"))
    runs = langid.labelled(frame(spark, [text]), field, runs=True).first()["runs"]
    share = Counter()
    for r in runs:
        share[r["lang"]] += r["end"] - r["start"]
    assert runs[0]["lang"] == "en" and runs[-1]["lang"] == "de" and min(share["en"], share["de"]) > 20


def test_forward_backward_against_paths():
    r = np.random.default_rng(0)
    e, a, s = r.normal(size=(5, 3)), r.normal(size=(3, 3)), r.normal(size=3)
    total = np.zeros((5, 3))
    for path in np.ndindex(3, 3, 3, 3, 3):
        w = np.exp(s[path[0]] + sum(e[i, p] for i, p in enumerate(path)) + sum(a[p, q] for p, q in zip(path, path[1:], strict=False)))
        for i, p in enumerate(path):
            total[i, p] += w
    gamma, _, _ = langid.forward_backward(e, np.ones(5, int), a, s)
    assert np.allclose(gamma, total / total.sum(axis=1, keepdims=True), atol=1e-4)


# 5 Mixing


def test_mix_edges(spark, odd, empty):
    sizes = mixing.sized(odd.select("doc_id", F.when(F.col("doc_id") != 4, F.col("source")).alias("source"), "text")).drop("text")
    targets = mixing.source_targets(sizes)
    out = mixing.mix(sizes, targets).collect()
    assert len(out) == 11 and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    total = sum(r["size"] for r in out)
    assert sum(r["target"] for r in targets.collect()) == pytest.approx(1.5 * total)
    assert abs(sum(r["taken"] for r in out) - 1.5 * total) <= max(r["size"] for r in out)
    assert mixing.mixed(odd).columns == odd.columns
    none = mixing.sized(empty.select("doc_id", "source", "text")).drop("text")
    assert mixing.mix(none, mixing.source_targets(none)).count() == 0


def test_mix_splits_its_edge(spark):
    sizes = spark.createDataFrame([(i, f"s{i % 2}", 1 + i % 5) for i in range(900)], "doc_id long, source string, size long")
    a = {r["doc_id"]: r["taken"] for r in mixing.mix(sizes, mixing.source_targets(sizes), n_ranges=8, edge_rows=10).collect()}
    b = {r["doc_id"]: r["taken"] for r in mixing.mix(sizes, mixing.source_targets(sizes)).collect()}
    assert a == b


# 6 Exact top-k


def test_top_k_edges(spark):
    r = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in r.normal(size=8)]) for i in range(130)] + [(200, [0.0] * 8), (300, [0.5] * 8), (301, [0.5] * 8), (302, None), (303, [None] * 8), (304, [float("nan")] * 8), (None, [1.0] * 8), (400, [1.0] * 3)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    rows = bitsliced.quantise(df)
    got = {}
    for x in bitsliced.search(bitsliced.build_index(rows, block=32), rows.where("vec_id % 100 = 0"), k=10, query_block=2).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    q = {i: np.floor(1024 * np.array(v, float)).astype(np.int64) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all()}
    for i in (0, 100, 200, 300):
        best = sorted(((-int(q[i] @ v), j) for j, v in q.items() if j != i and len(v) == len(q[i])))[:10]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert 400 not in got
    none = rows.limit(0)
    assert bitsliced.search(bitsliced.build_index(none), none).count() == 0


def test_components_too_large(spark):
    df = spark.createDataFrame([(1, [1e17, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        bitsliced.quantise(df).collect()


# 7 Sharding


def test_shards_of_repeated_rows(spark):
    """Equal rows spread over the shards, whatever the files; places are gapless."""
    rows = [(1, "same text " * 5)] * 9000 + [(k, "x" * (k % 50)) for k in range(2, 800)] + [(None, None)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string")
    columns = ["doc_id", "size", "text_crc32", "virtual_slot", "shard", "slot"]
    got = [sharding.shard_documents(d).select(*columns).collect() for d in (df.repartition(3), df.coalesce(1))]
    assert Counter(map(tuple, got[0])) == Counter(map(tuple, got[1])) and len(got[0]) == len(rows)
    by_shard = {s: [r for r in got[0] if r["shard"] == s] for s in range(8)}
    size = [sum(r["size"] for r in by_shard[s]) for s in range(8)]
    assert max(size) < 1.02 * min(size)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by_shard.values())


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """A labelled id that repeats gives one text."""
    monkeypatch.setattr(toxicity, "MAX_TOXIC", 3)
    docs = spark.createDataFrame([(2, f"t{k}") for k in range(200)] + [(k, "u") for k in range(3, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(2, 30)] + [(2, 1)], "doc_id long, toxic long")
    assert len(toxicity.sample(docs, labels)[0]) <= 3


def test_shards(spark, documents, odd, empty, tmp_path):
    out = sharding.shard_documents(documents, 8, map_path=str(tmp_path / "map"))
    rows = out.collect()
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= max(r["size"] for r in rows)
    stored = sharding.read_map(spark, str(tmp_path / "map"))
    assert all(stored[r["virtual_slot"]] == r["shard"] for r in rows)
    loads = sharding.slot_loads(out.select("virtual_slot", "size"))
    assert sharding.edit_map(spark, str(tmp_path / "map"), loads, 9) == 2
    grown = sharding.read_map(spark, str(tmp_path / "map"))
    assert sharding.read_map(spark, str(tmp_path / "map"), 1) == stored and grown == sharding.rebalance(stored, loads, 9)
    with pytest.raises(Exception, match="already exists"):
        sharding.write_map(sharding.map_frame(spark, stored, loads, 2), str(tmp_path / "map"), 2)
    brute = {(r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in documents.collect()}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == brute
    assert sum(grown[s] != stored[s] for s in stored) < len(stored) / 4
    assert sharding.shard_documents(odd).count() == 11
    assert sharding.shard_documents(empty).count() == 0
    assert sharding.placed(odd).columns == [*odd.columns, "virtual_slot", "shard"]


# 8 Chat


def test_reply_trees(spark):
    nodes = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 1.0), ("t", 3, 1, "assistant", "good", 2.0), ("t", 4, 3, "user", None, 0.0), ("t", 5, 4, "assistant", chat.TRICKY + "<|end|>\\", 1.0), ("u", 1, 9, "user", "alone", 0.0), ("c", 1, 2, "user", "loop", 0.0), ("c", 2, 1, "user", "loop", 0.0)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    out = {r["tree"]: r for r in chat.format_trees(df).collect()}
    assert set(out) == {"t", "u"}
    f = out["t"]["formatted"]
    assert f.count("<|turn|>") == 4 and "bad" not in f
    spans = [f[s["start"] : s["end"]] for s in out["t"]["loss_spans"]]
    assert [re.sub(r"\\([\\|])", r"\1", x) for x in spans] == ["good", chat.TRICKY + "<|end|>\\"]
    assert chat.format_trees(df, best=2).count() == 3
    assert chat.format_trees(df.limit(0)).count() == 0


def test_deep_chain(spark):
    df = spark.createDataFrame([("t", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(300)], "tree string, node long, parent long, role string, text string, score double")
    assert chat.digest(chat.format_trees(df)).first()["n_turns"] == 300


# 9 Personal data


def brute_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_base_spans(spark, empty):
    texts = ["a@b.c_d@e.f", "x@y.z@w.q a@b", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.0.255", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "+1 (234) 555-1234x +12 ... 3", "1" * 50, "é4111111111111111é😀 a@b.cc", "256.1.1.1.1", None, "", "9" * 20_000, "a" * 20_000]
    texts += ["".join(rnd.choice("0123456789.  -+()ab@") for _ in range(60)) for _ in range(400)]
    for r in pii.find_base(frame(spark, texts)).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"]] == brute_spans(texts[r["doc_id"]] or "")
    assert pii.find(empty).count() == 0


def test_disclosing_terms(spark):
    some = lambda n: " ".join(f"w{rnd.choice('abcdefghij')}{rnd.choice('klmnopqrst')}" for _ in range(n))
    texts = [f"{some(30)} Zyxwara writes to ann@corp.example {some(30)}" for _ in range(6)] + [some(40) + " writes " + some(5) for _ in range(80)]
    out = {r["doc_id"]: r for r in pii.find(frame(spark, texts)).collect()}
    for i in range(6):
        words = {texts[i][t["start"] : t["end"]]: t["action"] for t in out[i]["terms"]}
        assert words.get("Zyxwara") == "remove" and words.get("writes") != "remove"
    assert not any(out[i]["terms"] for i in range(6, 86))
    clean = frame(spark, texts[:6]).join(pii.find(frame(spark, texts)), "doc_id").select(pii.redact(F.col("text"), F.col("spans"), F.col("terms")).alias("x"))
    for r in clean.collect():
        assert "[EMAIL]" in r["x"] and "Zyxwara" not in r["x"]


def test_flagged_terms_everywhere(spark):
    """A flagged term goes from every text: far from the entity, in documents without it and without any base span, in each spelling."""
    far = " ".join(f"plain{'abcdefghij'[i % 10]}" for i in range(60))
    texts = [f"{far} {'abcdefgh'[i] * 4} Zyxwara writes to ann@corp.example {'abcdefgh'[i] * 4} {far}" for i in range(6)]
    texts[5] += " ZYXWARA again, zyxwara, Zyxwaras zyxwara@x.example éZyxwara"
    texts += [f"{far} zyxwara", f"Zyxwara {far} bob@other.example", None] + [f"{far} writes {i}" for i in range(300)]
    out = {r["doc_id"]: r for r in pii.find(frame(spark, texts)).collect()}
    assert len(out) == len(texts)
    for i, text in enumerate(texts):
        want = [(m.start(), m.end(), "remove") for m in re.finditer(r"(?<!\w)zyxwara(?![\w@])", text or "", re.I)]
        assert [tuple(t) for t in out[i]["terms"]] == want, i
    assert [len(out[i]["terms"]) for i in range(9)] == [1, 1, 1, 1, 1, 3, 1, 1, 0]


def test_copies_disclose_nothing(spark):
    """A word that edited copies of one text have beside an address is not evidence, however many they are."""
    texts = [f"{'abcdefgh'[i] * 4} plain words Zyxwara writes to ann@corp.example soon after" for i in range(8)] + [f"plain words {i}" for i in range(300)]
    assert not any(r["terms"] for r in pii.find(frame(spark, texts)).collect())


def test_disclosure_against_sql(spark):
    """The whole operator against its SQL where two contexts are enough, which flags terms in these tables."""
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = sorted(tuple(map(str, r)) for r in con.execute(pii.SQL.replace("{support}", "2")).fetchall())
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(tuple(map(str, r)) for r in pii.digest(pii.find(docs, support=2)).collect())
    assert got == want and sum(int(r[-1]) for r in got) > 10


def test_many_spans(spark):
    text = " ".join(f"user{i} wrote to person{i}@corp{i % 7}.example about 10.0.{i % 250}.1 today" for i in range(5000))
    out = pii.digest(pii.find(frame(spark, [text, text, None]))).orderBy("doc_id").collect()
    assert [(r["n_email"], r["n_ip"]) for r in out] == [(5000, 5000), (5000, 5000), (0, 0)]
    want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(text))
    assert out[0]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


# 10 Near-duplicates


def brute_classes(docs):
    hasher = neardup.Hasher()
    bags = [hasher.bag(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (docs[i][1] or "") == (docs[j][1] or "") or neardup.similarity(bags[i], bags[j]) >= 0.8:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = root(i)
        least[r] = min(least.get(r, d), d)
    return {d: least[root(i)] for i, (d, _) in enumerate(docs)}


def edit(text, n):
    ws = text.split()
    for i in rnd.sample(range(len(ws)), n):
        ws[i] = rnd.choice(VOCAB)
    return " ".join(ws)


def test_near_duplicates(spark, empty):
    base = prose(150)
    family = [base] + [edit(base, rnd.randrange(1, 7)) for _ in range(60)]
    texts = family + [prose(120) for _ in range(20)] + [" ".join(["w"] * 40), " ".join(["w"] * 42), " ".join(["w"] * 90), None, "", "two words", "Two, words!"]
    docs = list(enumerate(texts))
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(frame(spark, texts)).collect()}
    assert got == brute_classes(docs)
    assert neardup.classes(empty).count() == 0


def test_near_duplicates_in_parts(spark, monkeypatch):
    """Buckets dealt to parts of two members with one leader at first give the classes of brute force."""
    monkeypatch.setattr(neardup, "PART", 2)
    monkeypatch.setattr(neardup, "LEADERS", 1)
    monkeypatch.setattr(neardup, "near", lambda a, b, threshold: F.lit(True))
    base = prose(60)
    texts = [edit(base, rnd.randrange(1, 6)) for _ in range(40)] + [prose(60) for _ in range(5)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(frame(spark, texts)).collect()}
    assert got == brute_classes(list(enumerate(texts)))


def test_near_duplicate_edges(spark, odd):
    out = neardup.classes(odd).collect()
    assert len(out) == 11
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert by[None] == {5} and by[8] == {6} and by[0] == by[1] == {0}
    kept = neardup.survivors(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 4, 5, 6, 7]


def test_signatures_are_unbiased():
    r = np.random.default_rng(0)
    z = []
    for _ in range(30):
        key = np.sort(r.integers(0, 2**63, 40).astype(np.uint64))
        a, b = r.integers(0, 9, 40), r.integers(0, 9, 40)
        j = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        s = neardup.signatures([(key[a > 0], a[a > 0]), (key[b > 0], b[b > 0])], 1024)
        z.append(((s[0] == s[1]).mean() - j) / np.sqrt(j * (1 - j) / 1024))
    assert abs(np.mean(z)) < 0.8 and np.std(z) < 1.6


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.components(links).collect()}
    assert {got[i] for i in range(201)} == {0} and got[501] == 500
    assert components.components(links.limit(0)).count() == 0
