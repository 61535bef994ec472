"""Queries of many-term matching, crawl frontiers, containment lookups and paged scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import containment, frontier, patterns
from ..sources import readers
from .registry import query, table
from .shared import shared_folder

# Terms: the words of five letters and more that most documents hold. The first are the first tier, the next the second, then the overlay.
N_TERMS, TIER_ONE, TIER_TWO = 240, 52, 202
LOW = "lower(coalesce(text, ''))"
TERMS_SQL = f"""words AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all({LOW}, '[a-z]{{5,}}'))) AS w FROM documents),
terms AS (SELECT w AS term, (row_number() OVER (ORDER BY n DESC, w) - 1)::INT AS k FROM (SELECT w, count(DISTINCT doc_id) AS n FROM words GROUP BY w) QUALIFY k < {N_TERMS})"""


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))


def common_words(spark, sf):
    words = docs(spark, sf).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit("[a-z]{5,}"), F.lit(0)))).alias("w"))
    n = words.groupBy("w").agg(F.count_distinct("doc_id").alias("n"))
    return [r["w"] for r in n.orderBy(F.desc("n"), "w").limit(N_TERMS).collect()]


@query(
    "term_hits",
    f"""WITH {TERMS_SQL}, h AS (SELECT d.doc_id, t.term, t.k, (length(low) - length(replace(low, term, ''))) // length(term) AS n, instr(low, term) - 1 AS first
 FROM (SELECT doc_id, {LOW} AS low FROM documents) d JOIN terms t ON contains(d.low, t.term))
SELECT term, count(*) AS n_docs, sum(n)::BIGINT AS n_times, max(n)::BIGINT AS most, sum(first)::BIGINT AS firsts FROM h GROUP BY term""",
)
def term_hits(spark, sf):
    """Of each of 240 terms the documents that hold it, its occurrences, the most in one document, and the sum of its first places."""
    terms = common_words(spark, sf)
    hits = docs(spark, sf).select(F.explode(patterns.find_terms(F.col("low"), terms)).alias("h"))
    n = hits.groupBy("h.term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("h.n").alias("n_times"), F.max("h.n").cast("long").alias("most"), F.sum("h.first").alias("firsts"))
    return n.select(F.element_at(F.array(*[F.lit(t) for t in terms] or [F.lit("")]), F.col("term") + 1).alias("term"), "n_docs", "n_times", "most", "firsts")


@query(
    "dual_tier_terms",
    f"""WITH {TERMS_SQL}, d AS (SELECT doc_id, {LOW} AS low, string_split({LOW}, chr(10))[1] AS title FROM documents),
h AS (SELECT d.doc_id, t.k, instr(low, term) AS at, (length(low) - length(replace(low, term, ''))) // length(term) AS n, contains(title, term) AS titled FROM d JOIN terms t ON contains(d.low, t.term) WHERE length(low) >= 150)
SELECT doc_id FROM h GROUP BY doc_id HAVING bool_or(k < {TIER_TWO}) AND (bool_or(k >= {TIER_TWO} AND titled) OR sum(CASE WHEN k >= {TIER_TWO} THEN n ELSE 0 END) >= 3)
UNION SELECT a.doc_id FROM h a JOIN h b USING (doc_id) WHERE a.k >= {TIER_TWO} AND b.k BETWEEN {TIER_ONE} AND {TIER_TWO - 1} AND abs(a.at - b.at) < 500""",
)
def dual_tier_terms(spark, sf):
    """The dual-tier filter with 52, 150 and 38 terms; a title is a text's first line."""
    terms = common_words(spark, sf)
    low = F.col("low")
    return patterns.dual_tier(docs(spark, sf), low, F.substring_index(low, "\n", 1), terms[:TIER_ONE], terms[TIER_ONE:TIER_TWO], terms[TIER_TWO:]).select("doc_id")


@query(
    "white_black_terms",
    f"""WITH {TERMS_SQL}, h AS (SELECT doc_id, k, instr(low, term) - 1 + length(term) <= 2500 AS early FROM (SELECT doc_id, {LOW} AS low FROM documents) d JOIN terms t ON contains(d.low, t.term) WHERE length(low) >= 200)
SELECT doc_id FROM h GROUP BY doc_id HAVING bool_or(k BETWEEN 80 AND 146 AND early) AND count(*) FILTER (k < 80) >= 3 AND count(*) FILTER (k >= 147) <= 3 * count(*) FILTER (k < 80)""",
)
def white_black_terms(spark, sf):
    """The white and black lists with 80 white terms, 67 phrases and 93 black terms."""
    terms = common_words(spark, sf)
    return patterns.white_black(docs(spark, sf), F.col("low"), terms[:80], terms[147:], terms[80:147]).select("doc_id")


# A link's target: the page whose number is a hash of the link, as a site would redirect it.
TARGET = "('0x' || substr(md5(link), 1, 8))::BIGINT % (SELECT count(*) FROM pages)"


def page_links(spark, sf):
    p = table(spark, sf, "pages")
    n = p.agg(F.count(F.lit(1)).alias("n"))
    found = p.select(F.col("page_id").alias("src"), F.posexplode(T.links(F.col("html"))).alias("pos", "link"))
    target = F.conv(F.substring(F.md5("link"), 1, 8), 16, 10).cast("long")
    return found.join(F.broadcast(n)).select("src", (target % F.col("n")).alias("dst"), "pos")


@query(
    "crawl_frontier",
    f"""WITH RECURSIVE l AS (SELECT page_id AS src, {TARGET} AS dst, pos FROM (SELECT page_id, unnest(k) AS link, generate_subscripts(k, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS k FROM pages))),
used AS (SELECT DISTINCT src, dst FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY src ORDER BY pos, dst) <= 2) WHERE dst % 7 <> 3),
reach AS (SELECT page_id AS page, 0 AS depth FROM pages WHERE page_id < 3 UNION SELECT dst, depth + 1 FROM reach JOIN used ON src = page WHERE depth < 6)
SELECT page, min(depth) AS depth FROM reach GROUP BY page""",
)
def crawl_frontier(spark, sf):
    """Pages within six levels of three seeds, two links a page, every seventh page barred; the graph has cycles."""
    seeds = table(spark, sf, "pages").where("page_id < 3").select(F.col("page_id").alias("page"))
    return frontier.crawl(page_links(spark, sf), seeds, lambda: shared_folder(spark, "frontier"), depth=6, fan_out=2, follow=F.col("dst") % 7 != 3)


@query(
    "crawl_closure",
    f"""WITH RECURSIVE l AS (SELECT DISTINCT src, {TARGET} AS dst FROM (SELECT page_id AS src, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages)),
reach AS (SELECT page_id AS page FROM pages WHERE page_id = 0 UNION SELECT dst FROM reach JOIN l ON src = page) SELECT page FROM reach""",
)
def crawl_closure(spark, sf):
    """All that the first page reaches, whatever the depth."""
    seeds = table(spark, sf, "pages").where("page_id = 0").select(F.col("page_id").alias("page"))
    return frontier.crawl(page_links(spark, sf), seeds, lambda: shared_folder(spark, "frontier")).select("page")


CODES_SQL = """codes AS (SELECT DISTINCT upper(w) AS code FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]{3,}')) AS w FROM documents)),
keys AS (SELECT DISTINCT upper(regexp_extract(url, '^[a-z]+://([^./]+)', 1)) AS key FROM pages UNION SELECT DISTINCT upper(w) FROM (SELECT unnest(regexp_extract_all(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '[a-zA-Z]{6,}')) AS w FROM pages))"""


def codes(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-zA-Z]{3,}"), F.lit(0))).alias("w"))
    return words.select(F.upper("w").alias("code")).distinct()


def keys(spark, sf):
    p = table(spark, sf, "pages")
    hosts = p.select(F.upper(F.regexp_extract("url", "^[a-z]+://([^./]+)", 1)).alias("key"))
    titles = p.select(F.explode(F.regexp_extract_all(F.regexp_extract("html", "(?s)<title[^>]*>(.*?)</title>", 1), F.lit("[a-zA-Z]{6,}"), F.lit(0))).alias("w"))
    return hosts.union(titles.select(F.upper("w"))).distinct()


@query(
    "containment_lookup",
    f"""WITH {CODES_SQL}, m AS (SELECT key, code FROM keys JOIN codes ON contains(key, code) OR contains(code, key) WHERE key <> '')
SELECT key, code, CASE WHEN key = code THEN 'exact' WHEN contains(key, code) THEN 'holds' ELSE 'within' END AS how FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY key <> code, length(code) DESC, code) = 1""",
)
def containment_lookup(spark, sf):
    """Host and title words of pages against the words of all documents as codes: the equal code, else the longest of those that hold the word or that it holds."""
    return containment.lookup(keys(spark, sf), codes(spark, sf))


LIMIT = 5
BLOCK = 1000  # pages of a year in one folder


@query(
    "paged_scan",
    f"""WITH p AS (SELECT page_id, 2017 + page_id % 10 AS year, page_id // 50 AS page, (page_id // 2)::VARCHAR AS id, url AS title FROM pages WHERE NOT (page_id % 10 = 4 AND page_id // 50 = 2 AND page_id % 3 = 0)),
n AS (SELECT year, page, count(*) AS n FROM p GROUP BY ALL),
s AS (SELECT year, coalesce(min(page) FILTER (n < {LIMIT}), 1000000) AS last, min(page) AS first FROM n GROUP BY year)
SELECT year::INT AS year, CASE WHEN page_id % 7 <> 0 THEN id ELSE '' END AS id, title, '' AS date FROM p JOIN s USING (year) WHERE page <= last AND page < 4 AND page_id % 7 <> 0 AND year >= 2019
QUALIFY row_number() OVER (PARTITION BY year, id ORDER BY page_id) = 1""",
)
def paged_scan(spark, sf):
    """Pages land as JSON answers of at most five rows by year and page; a year's scan ends at its first short page, at a missing one, or after four."""
    value = lambda c: F.struct(c.alias("value"))
    k = F.col("page_id")
    p = table(spark, sf, "pages").where(~((k % 10 == 4) & (F.floor(k / 50) == 2) & (k % 3 == 0)))
    one = F.struct(value(F.when(k % 7 != 0, F.floor(k / 2).cast("string"))).alias("id"), value(F.col("url")).alias("title"), F.lit(None).cast("struct<value:string>").alias("date"))
    answers = p.groupBy((2017 + k % 10).alias("year"), F.floor(k / 50).alias("page")).agg(F.array_sort(F.collect_list(F.struct("page_id", one.alias("b")))).alias("all"))
    folder = shared_folder(spark, "landing")
    landed = answers.select("year", F.floor(F.col("page") / BLOCK).alias("block"), "page", F.struct(F.transform("all", lambda x: x["b"]).alias("bindings")).alias("results"))
    landed.repartition("year", "block").write.partitionBy("year", "block").json(folder)
    return readers.paged_bindings(spark, folder, ["id", "title", "date"], "id", limit=LIMIT, most_pages=4, block=BLOCK).where("year >= 2019")
