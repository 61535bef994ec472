"""Many terms, crawl frontiers, containment and paged scans against slow versions."""

import json
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import containment, frontier, patterns
from corpusloom.sources import readers


def new_folders(tmp_path):
    return lambda: str(tmp_path / uuid.uuid4().hex)


def test_term_hits_against_count(spark):
    """Terms within terms, terms that overlap themselves, repeated terms, no text."""
    rnd = random.Random(4)
    texts = [None, "", "aaaa", *("".join(rnd.choice("aab ") for _ in range(rnd.randrange(60))) for _ in range(60)), "é😀aé😀"]
    terms = ["a", "aa", "aba", "a", "ab a", "zz", "😀", "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", patterns.find_terms(F.col("t"), terms).alias("hits"))
    for r in df.collect():
        t = texts[r["id"]] or ""
        assert sorted((h["term"], h["n"], h["first"]) for h in r["hits"]) == [(k, t.count(x), t.find(x)) for k, x in enumerate(terms) if x in t]
    with pytest.raises(ValueError):
        patterns.find_terms(F.col("t"), ["a", ""])


def test_time_is_flat_in_terms(spark):
    """Two hundred terms cost little more than ten."""
    text = " ".join(f"word{k % 911}" for k in range(2000))
    df = spark.range(400).select(F.concat(F.lit(text), F.col("id").cast("string")).alias("t")).cache()
    df.count()
    took = {}
    for n in (10, 10, 200):
        start = time.perf_counter()
        df.select(patterns.find_terms(F.col("t"), [f"none{k}of" for k in range(n)]).alias("h")).write.format("noop").mode("overwrite").save()
        took[n] = time.perf_counter() - start
    assert took[200] < 3 * took[10] + 1


def test_filters_against_rules(spark):
    one, two, over = ["tariff", "steel"], ["solar"], ["china", "prc"]
    pad = "x" * 600
    rows = [
        (1, f"tariff {pad} china", ""), (2, f"tariff {pad} china", "China day"), (3, f"tariff {pad} china prc china", ""), (4, f"solar china {pad}", ""),
        (5, f"solar {pad} china", ""), (6, f"china china china {pad}", ""), (7, "solar china", ""), (8, f"steel {pad}", "prc"), (9, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, low string, title string")
    assert [r["id"] for r in patterns.dual_tier(df, F.col("low"), F.lower("title"), one, two, over).orderBy("id").collect()] == [2, 3, 4, 8]
    white, black, phrases = ["aa", "bb", "cc"], ["z1", "z2", "z3", "z4", "z5", "z6", "z7", "z8", "z9", "z0"], ["key phrase"]
    good = f"key phrase aa bb cc {pad}"
    rows = [(1, good), (2, good[: -len(pad)]), (3, good.replace("cc", "")), (4, f"{pad * 5} {good}"), (5, good + " ".join(black)), (6, good + " ".join(black[:9])), (7, "x" * 2490 + " key phrase aa bb cc")]
    df = spark.createDataFrame(rows, "id int, low string")
    assert [r["id"] for r in patterns.white_black(df, F.col("low"), white, black, phrases).orderBy("id").collect()] == [1, 6]


@pytest.mark.parametrize(("depth", "fan_out"), [(None, None), (2, None), (None, 2), (3, 1), (0, None)])
def test_crawl_against_search(spark, tmp_path, depth, fan_out):
    """Cycles, self links, repeated links, dead ends, null pages."""
    rnd = random.Random(6)
    links = [(s, rnd.randrange(40), k) for s in range(30) for k in range(rnd.randrange(4))] + [(0, 0, 9), (0, 1, 9), (0, 1, 9), (None, 2, 0), (3, None, 0)]
    got = frontier.crawl(spark.createDataFrame(links, "src int, dst int, pos int"), spark.createDataFrame([(0,), (0,), (5,), (None,)], "page int"), new_folders(tmp_path), depth, fan_out)
    out = {s: [d for _, d in sorted((p, -1 if d is None else d) for x, d, p in links if x == s)][:fan_out] for s in range(30)}
    want, level = {0: 0, 5: 0}, 0
    new = [0, 5]
    while new and (depth is None or level < depth):
        level += 1
        new = sorted({d for s in new for d in out.get(s, []) if d >= 0 and d not in want})
        want |= dict.fromkeys(new, level)
    assert sorted((r["page"], r["depth"]) for r in got.collect()) == sorted(want.items())


def test_crawl_stops(spark, tmp_path):
    chain = spark.range(20).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(0).alias("pos"))
    seeds = spark.range(1).select(F.col("id").alias("page"))
    got = frontier.crawl(chain, seeds, new_folders(tmp_path), stop=lambda new: new.where("page >= 4").count() > 0)
    assert got.count() == 5 and frontier.crawl(chain, seeds.limit(0), new_folders(tmp_path)).count() == 0
    assert frontier.crawl(chain, seeds, new_folders(tmp_path), follow=F.col("dst") != 3).count() == 3


def test_sitemaps_once(spark, tmp_path):
    """A map listed at two levels, a cycle, a map that lists another beside pages: each map's pages come once."""
    entry = lambda tag, u: f"<{tag}><loc> {u} </loc></{tag}>"
    rows = [("root", entry("sitemap", "a") + entry("sitemap", "b") + entry("sitemap", "lost")), ("a", entry("sitemap", "b") + entry("sitemap", "root") + entry("url", "u1")), ("b", entry("url", "u2") + "<url><lastmod>x</lastmod></url>")]
    df = spark.createDataFrame(rows, "map string, xml string")
    assert sorted(tuple(r) for r in readers.sitemap_tree(df, "root", new_folders(tmp_path)).collect()) == [("u1", "", 1), ("u2", "", 1)]
    assert [r["url"] for r in readers.sitemap_rows(df).collect()] == ["u1", "u2"]


def test_containment_against_all_pairs(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("ABC") for _ in range(rnd.randrange(0, 9)))
    keys, codes = [word() for _ in range(80)] + [None, "ABCABCABCA"], [word() for _ in range(60)] + [None, "ABCABCABCA"]
    k, c = spark.createDataFrame([(x,) for x in keys], "key string"), spark.createDataFrame([(x,) for x in codes], "code string")
    want = {(a, b) for a in keys for b in codes if a and b and (a in b or b in a)}
    assert {tuple(r) for r in containment.contained(k, c).collect()} == want
    best = {a: min((a != b, -len(b), b) for x, b in want if x == a)[2] for a, _ in want}
    assert {r["key"]: r["code"] for r in containment.lookup(k, c).collect()} == best
    ranked = spark.createDataFrame([("AB", 2), ("ABC", 1), ("ABCD", 0)], "code string, rank int")
    got = {tuple(r) for r in containment.lookup(spark.createDataFrame([("XABCX",), ("ABC",), ("BC",), ("Q",)], "key string"), ranked, "rank").collect()}
    assert got == {("XABCX", "ABC", "holds"), ("ABC", "ABC", "exact"), ("BC", "ABCD", "within")}


def test_paged_scan_stops(spark, tmp_path):
    """A short page, an empty one, a missing one, too many pages; keys repeat within and between years."""

    def land(year, page, ids):
        at = tmp_path / f"year={year}" / f"page={page}"
        at.mkdir(parents=True)
        (at / "a.json").write_text(json.dumps({"results": {"bindings": [{"id": {"value": i}, "title": {"value": f"{year}.{page}"}} if i else {"title": {"value": "x"}} for i in ids]}}))

    for page, ids in enumerate([["a", "b"], ["b", "c"], ["d"], ["e", "f"]]):
        land(2020, page, ids)
    for page, ids in [(0, ["a", ""]), (2, ["z", "y"])]:
        land(2021, page, ids)
    for page in range(5):
        land(2022, page, [f"p{page}", "q"])
    land(2023, 0, [])
    land(2023, 1, ["n", "m"])
    got = sorted((r["year"], r["id"], r["title"]) for r in readers.paged_bindings(spark, str(tmp_path), ["id", "title"], "id", limit=2, most_pages=3).collect())
    want = [(2020, "a", "2020.0"), (2020, "b", "2020.0"), (2020, "c", "2020.1"), (2020, "d", "2020.2"), (2021, "a", "2021.0")]
    assert got == want + [(2022, "p0", "2022.0"), (2022, "p1", "2022.1"), (2022, "p2", "2022.2"), (2022, "q", "2022.0")]


def test_paged_scan_prunes_folders(spark, tmp_path):
    (tmp_path / "year=2020" / "page=0").mkdir(parents=True)
    (tmp_path / "year=2020" / "page=0" / "a.json").write_text('{"results":{"bindings":[]}}')
    plan = readers.paged_bindings(spark, str(tmp_path), ["id"], "id").where("year = 2020")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_paged_scan_in_blocks(spark, tmp_path):
    """Answers in blocks of pages, one of which ends within the pages that are read, as answers in folders of their own."""
    answers = [(2020 + y, page, [f"{y}.{page}.{k}" for k in range(2 - (page == 5 + y))]) for y in range(4) for page in range(12) if (y, page) != (3, 2)]
    for year, page, ids in answers:
        line = {"page": page, "results": {"bindings": [{"id": {"value": i}} for i in ids]}}
        for at in (tmp_path / "one" / f"year={year}" / f"page={page}", tmp_path / "many" / f"year={year}" / f"block={page // 3}"):
            at.mkdir(parents=True, exist_ok=True)
            (at / f"{page}.json").write_text(json.dumps(line if at.parts[-3] == "many" else {"results": line["results"]}))
    read = lambda folder, **k: sorted(map(tuple, readers.paged_bindings(spark, str(tmp_path / folder), ["id"], "id", limit=2, most_pages=8, **k).collect()))
    assert read("many", block=3) == read("one") and len(read("one")) > 30


def test_paged_scan_lands_in_few_folders(spark, tmp_path, monkeypatch):
    from corpusloom.plans import lookup_queries as Q

    monkeypatch.setattr(Q, "shared_folder", lambda *_: str(tmp_path / "landing"))
    spark.range(3000).selectExpr("id AS page_id", "concat('u', id) AS url").write.parquet(str(tmp_path / "pages.parquet"))
    assert Q.paged_scan(spark, str(tmp_path)).count() > 0
    assert len(list((tmp_path / "landing").glob("year=*/*"))) == 10
