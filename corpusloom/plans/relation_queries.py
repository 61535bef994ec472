"""Queries of joins, keyed tables, sets, windows, aggregates and increments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import tables as T
from ..sources import sinks
from ..streaming import incremental
from .registry import query, table
from .shared import shared_folder


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("dedup_keep_first", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_keep_first(spark, sf):
    """Texts are compared by a 256-bit hash, so the shuffle carries no text."""
    keyed = docs(spark, sf).select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    return T.keep_first(keyed, ["key"], ["doc_id"]).select("doc_id", "source")


@query("dedup_stats", "SELECT count(*) AS n, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS n_copies, count(DISTINCT (lang, source)) AS n_strata FROM documents")
def dedup_stats(spark, sf):
    d = docs(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.sha2("text", 256)).alias("n_distinct"), F.count_distinct(F.struct("lang", "source")).alias("n_strata"))
    return d.select("n", "n_distinct", (F.col("n") - F.col("n_distinct")).alias("n_copies"), "n_strata")


YEARS = "CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 = 1 THEN (2017 + doc_id % 10)::VARCHAR || '.0' ELSE (2017 + doc_id % 10)::VARCHAR END"


def year_column():
    y = (F.lit(2017) + F.col("doc_id") % 10).cast("string")
    return F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 7 == 1, F.concat(y, F.lit(".0"))).otherwise(y)


@query("merge_sort_nulls_last", f"SELECT doc_id, TRY_CAST({YEARS} AS DOUBLE)::INT AS year, row_number() OVER (ORDER BY TRY_CAST({YEARS} AS DOUBLE) NULLS LAST, doc_id) AS place FROM documents")
def merge_sort_nulls_last(spark, sf):
    y = year_column().try_cast("double")
    d = docs(spark, sf).select("doc_id", y.alias("y"))
    d = T.numbered(d, [F.col("y").asc_nulls_last(), F.col("doc_id").asc()], "place", shared_folder(spark, "places"))
    return d.select("doc_id", F.col("y").cast("int").alias("year"), "place")


@query("semi_join_gold", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join_gold(spark, sf):
    return docs(spark, sf).select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


@query("lookup_last_wins", "WITH k AS (SELECT text, max_by(source, doc_id) AS source, max(doc_id) AS last_id FROM documents GROUP BY text) SELECT d.doc_id, k.source AS last_source, k.last_id FROM documents d JOIN labels USING (doc_id) JOIN k ON d.text = k.text")
def lookup_last_wins(spark, sf):
    keyed = docs(spark, sf).select("doc_id", "source", F.sha2("text", 256).alias("key"))
    last = T.keep_last(keyed.select("key", "source", F.col("doc_id").alias("last_id")), ["key"], "last_id")
    gold = keyed.select("doc_id", "key").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return gold.join(last, "key").select("doc_id", F.col("source").alias("last_source"), "last_id")


@query("override_labels", "SELECT d.doc_id, coalesce(l.quality, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END) AS label, l.quality IS NOT NULL AS by_hand FROM documents d LEFT JOIN labels l USING (doc_id)")
def override_labels(spark, sf):
    machine = F.when(F.col("n_chars") > 1000, 1).otherwise(0)
    d = docs(spark, sf).select("doc_id", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.select("doc_id", F.coalesce("quality", machine).alias("label"), F.col("quality").isNotNull().alias("by_hand"))


@query("anti_join_pending", "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)")
def anti_join_pending(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    return p.join(p.where("page_id % 2 = 0").select("url"), "url", "left_anti").select("page_id", "url")


@query("unmatched_report", "SELECT count(*) FILTER (d.doc_id IS NULL) AS unmatched, count(*) AS total FROM labels l LEFT JOIN (SELECT doc_id FROM documents WHERE lang = 'en') d USING (doc_id)")
def unmatched_report(spark, sf):
    d = docs(spark, sf).where("lang = 'en'").select("doc_id", F.lit(1).alias("there"))
    return table(spark, sf, "labels").join(d, "doc_id", "left").agg(F.count_if(F.col("there").isNull()).alias("unmatched"), F.count(F.lit(1)).alias("total"))


@query(
    "parent_child_text",
    """SELECT o_orderkey, max(merged) AS merged, coalesce(max(n), 0)::INT AS n_children FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(l_returnflag || l_linenumber::VARCHAR, '---' ORDER BY l_linenumber, l_returnflag || l_linenumber::VARCHAR) AS merged, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1""",
)
def parent_child_text(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("part"))
    out = T.children_text(table(spark, sf, "orders").select("o_orderkey"), lines, "o_orderkey", "l_orderkey", ["l_linenumber"], "part", "---")
    return out.select("o_orderkey", "merged", F.coalesce("n_children", F.lit(0)).alias("n_children"))


@query("graph_optional", "SELECT n_nationkey, n_name, r_name, s.n AS suppliers FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 3 LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON s_nationkey = n_nationkey")
def graph_optional(spark, sf):
    n = table(spark, sf, "nation")
    s = table(spark, sf, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    r = table(spark, sf, "region").where("r_regionkey <> 3").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return n.join(r, "n_regionkey", "left").join(s, "n_nationkey", "left").select("n_nationkey", "n_name", "r_name", "suppliers")


@query("graph_not_exists", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal < 0)")
def graph_not_exists(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    failed = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    poor = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return c.join(failed, "c_custkey", "left_anti").join(poor, "c_nationkey", "left_anti").join(n, "c_nationkey").select("c_custkey", "n_name")


@query("graph_union_edges", "SELECT DISTINCT parent, child, kind FROM (SELECT n_regionkey AS parent, n_nationkey AS child, 'nation' AS kind FROM nation UNION ALL SELECT s_nationkey, s_suppkey, 'supplier' FROM supplier UNION ALL SELECT c_nationkey, c_custkey, 'customer' FROM customer WHERE c_nationkey = 7)")
def graph_union_edges(spark, sf):
    edge = lambda t, a, b, k, w="true": table(spark, sf, t).where(w).select(F.col(a).cast("long").alias("parent"), F.col(b).cast("long").alias("child"), F.lit(k).alias("kind"))
    return edge("nation", "n_regionkey", "n_nationkey", "nation").union(edge("supplier", "s_nationkey", "s_suppkey", "supplier")).union(edge("customer", "c_nationkey", "c_custkey", "customer", "c_nationkey = 7")).distinct()


@query("offset_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def offset_page(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50)


@query("band_join", "SELECT a.event_id AS error_id, b.event_id AS click_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'click' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) < 600000000")
def band_join(spark, sf):
    """Pairs closer than ten minutes: equi-join on the time bucket and its neighbours, then the exact band."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    width = 600_000_000
    a = e.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("us").alias("a_us"), F.explode(F.array(*[F.floor(F.col("us") / width) + k for k in (-1, 0, 1)])).alias("bucket"))
    b = e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("us").alias("b_us"), F.floor(F.col("us") / width).alias("bucket"))
    return a.join(b, ["user_id", "bucket"]).where(F.abs(F.col("a_us") - F.col("b_us")) < width).select("error_id", "click_id")


@query("interval_containment", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 60 DAY")
def interval_containment(spark, sf):
    points = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_shipdate")
    spans = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate", (F.col("o_orderdate") + F.expr("INTERVAL 60 DAY")).alias("until"))
    return T.within(points, spans, "k", "l_shipdate", "o_orderdate", "until").select(F.col("k").alias("l_orderkey"), "l_linenumber")


@query("present_columns", "SELECT doc_id, source FROM documents WHERE lang = 'de'")
def present_columns(spark, sf):
    return T.select_present(docs(spark, sf).where("lang = 'de'"), ["doc_id", "sample_id", "source", "human_stance"])


@query("union_distinct_urls", "SELECT DISTINCT url FROM (SELECT url FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT url FROM pages WHERE page_id % 2 = 0)")
def union_distinct_urls(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    return p.where("page_id % 3 <> 0").union(p.where("page_id % 2 = 0")).select("url").distinct().orderBy("url")


@query("pending_urls", "SELECT url FROM pages WHERE page_id % 3 <> 0 EXCEPT SELECT url FROM pages WHERE page_id % 2 = 0")
def pending_urls(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    return p.where("page_id % 3 <> 0").select("url").subtract(p.where("page_id % 2 = 0").select("url"))


@query("keep_top_n_per_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def keep_top_n_per_group(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return T.top_n(o, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3)


@query("top_label", "SELECT source, max_by(lang, (n, -ord)) AS top_lang FROM (SELECT source, lang, count(*) AS n, dense_rank() OVER (PARTITION BY source ORDER BY lang) AS ord FROM documents GROUP BY source, lang) GROUP BY source")
def top_label(spark, sf):
    """First arg-max: of equal counts the first label."""
    n = docs(spark, sf).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("n"), "lang")).alias("best")).select("source", F.col("best.lang").alias("top_lang"))


@query("frequency_tables", "SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def frequency_tables(spark, sf):
    """All dimensions in one scan."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("lang", "source")])).alias("p")
    return docs(spark, sf).select(pairs).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n")).orderBy("dimension", F.desc("n"), "value")


@query("coverage", f"SELECT min(TRY_CAST({YEARS} AS DOUBLE)::INT) AS first_year, max(TRY_CAST({YEARS} AS DOUBLE)::INT) AS last_year, round(100.0 * count(*) FILTER ({YEARS} <> '') / count(*), 2) AS with_year, round(100.0 * count(*) FILTER (coalesce(source, '') <> '') / count(*), 2) AS with_source FROM documents")
def coverage(spark, sf):
    y = year_column()
    year = y.try_cast("double").cast("int")
    share = lambda c: F.round(F.count_if(c) * 100.0 / F.count(F.lit(1)), 2)
    return docs(spark, sf).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), share(y != "").alias("with_year"), share(F.coalesce("source", F.lit("")) != "").alias("with_source"))


@query("year_range_filter", f"SELECT doc_id FROM documents WHERE TRY_CAST({YEARS} AS DOUBLE) IS NULL OR TRY_CAST({YEARS} AS DOUBLE)::INT BETWEEN 2019 AND 2022")
def year_range_filter(spark, sf):
    y = year_column().try_cast("double").cast("int")
    return docs(spark, sf).where(y.isNull() | y.between(2019, 2022)).select("doc_id")


@query("drop_null_fill", "SELECT doc_id, coalesce(CASE WHEN doc_id % 5 <> 0 THEN source END, 'Unknown') AS source FROM documents WHERE CASE WHEN doc_id % 9 <> 0 THEN lang END IS NOT NULL")
def drop_null_fill(spark, sf):
    d = docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("source"))
    return d.na.drop(subset=["lang"]).na.fill("Unknown", ["source"]).select("doc_id", "source")


DAILY = "d AS (SELECT row_number() OVER (ORDER BY date_trunc('day', ts)) AS step, round(avg(value), 6) AS v FROM events GROUP BY date_trunc('day', ts))"


def daily(spark, sf):
    """One row a day, so the windows over it are small."""
    d = table(spark, sf, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))
    return d.select(F.row_number().over(Window.orderBy("day")).alias("step"), "v")


@query("moving_average", f"WITH {DAILY}, m AS (SELECT step, avg(v) OVER w AS m, count(*) OVER w AS n FROM d WINDOW w AS (ORDER BY step ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT step, round(m, 4) AS smoothed FROM m WHERE n = 5 AND (SELECT count(*) FROM d) > 20")
def moving_average(spark, sf):
    w = Window.orderBy("step").rowsBetween(-2, 2)
    d = daily(spark, sf).withColumn("m", F.avg("v").over(w)).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy()))
    return d.where("n = 5 and total > 20").select("step", F.round("m", 4).alias("smoothed"))


@query("early_stop", f"WITH {DAILY}, b AS (SELECT *, v > coalesce(max(v) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS better FROM d), g AS (SELECT *, sum(better::INT) OVER (ORDER BY step) AS grp FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY step) - 1 AS bad FROM g) SELECT step, v, better, bad::INT AS bad FROM r WHERE step <= coalesce((SELECT min(step) FROM r WHERE bad >= 2), 1000000)")
def early_stop(spark, sf):
    w = Window.orderBy("step")
    d = daily(spark, sf).withColumn("better", F.col("v") > F.coalesce(F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1.0)))
    d = d.withColumn("grp", F.sum(F.col("better").cast("int")).over(w))
    d = d.withColumn("bad", F.row_number().over(Window.partitionBy("grp").orderBy("step")) - 1)
    return T.until_true(d, "step", F.col("bad") >= 2).select("step", "v", "better", "bad")


LISTING = "l AS (SELECT (page_id // 10)::INT AS page, count(*) FILTER (url LIKE '%page=%' AND page_id % 3 = 0) AS links, min(2000 + (250 - page_id // 10) % 30) AS oldest FROM pages GROUP BY 1)"


def listing(spark, sf):
    link = F.contains("url", F.lit("page=")) & (F.col("page_id") % 3 == 0)
    page = F.floor(F.col("page_id") / 10).cast("int")
    return table(spark, sf, "pages").groupBy(page.alias("page")).agg(F.count_if(link).alias("links"), F.min(F.lit(2000) + (250 - page) % 30).alias("oldest"))


@query("empty_streak_stop", f"WITH {LISTING}, g AS (SELECT *, sum((links > 0)::INT) OVER (ORDER BY page) AS grp FROM l), r AS (SELECT *, sum((links = 0)::INT) OVER (PARTITION BY grp ORDER BY page) AS run FROM g) SELECT page, links FROM r WHERE page <= coalesce((SELECT min(page) FROM r WHERE run >= 2), 1000000)")
def empty_streak_stop(spark, sf):
    return T.until_streak(listing(spark, sf), "page", F.col("links") == 0, 2, shared_folder(spark, "listing")).select("page", "links")


@query("oldest_year_stop", f"WITH {LISTING} SELECT page, oldest FROM l WHERE page <= coalesce((SELECT min(page) FROM l WHERE oldest < 2005), 1000000)")
def oldest_year_stop(spark, sf):
    return T.until_true(listing(spark, sf), "page", F.col("oldest") < 2005).select("page", "oldest")


@query("new_links_stop", "WITH f AS (SELECT url, min(page_id // 10) AS page FROM pages GROUP BY url), p AS (SELECT DISTINCT (page_id // 10)::INT AS page FROM pages), c AS (SELECT p.page, count(f.url) AS new_links FROM p LEFT JOIN f USING (page) GROUP BY 1) SELECT page, new_links FROM c WHERE page <= coalesce((SELECT min(page) FROM c WHERE new_links = 0), 1000000)")
def new_links_stop(spark, sf):
    p = table(spark, sf, "pages").select("url", F.floor(F.col("page_id") / 10).cast("int").alias("page"))
    first = p.groupBy("url").agg(F.min("page").alias("page")).groupBy("page").agg(F.count(F.lit(1)).alias("new_links"))
    pages = p.select("page").distinct().join(first, "page", "left").na.fill(0, ["new_links"])
    return T.until_true(pages, "page", F.col("new_links") == 0)


@query("manifest_upsert", "SELECT url AS id, min_by(page_id, page_id) AS page_id, 'old' AS origin FROM pages WHERE page_id % 2 = 0 GROUP BY url UNION ALL SELECT url, min(page_id), 'new' FROM pages WHERE page_id % 2 = 1 AND url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0) GROUP BY url")
def manifest_upsert(spark, sf):
    p = table(spark, sf, "pages").select(F.col("url").alias("id"), "page_id")
    half = lambda k, name: T.keep_first(p.where(F.col("page_id") % 2 == k), ["id"], ["page_id"]).withColumn("origin", F.lit(name))
    return sinks.upsert_manifest(half(0, "old"), half(1, "new"), "id")


@query("idempotent_append", "SELECT count(*) AS n, count(DISTINCT url) AS n_urls FROM (SELECT DISTINCT url FROM pages)")
def idempotent_append(spark, sf):
    """The same batch twice, then all pages: each URL once."""
    p = table(spark, sf, "pages").select("url", "page_id")
    sink = p.limit(0)
    for batch in (p.where("page_id % 2 = 0"), p.where("page_id % 2 = 0"), p):
        sink = sink.unionByName(T.append_new(sink, batch, "url", "page_id"))
    return sink.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("n_urls"))


@query("export_ladder", "SELECT CASE WHEN doc_id % 4 = 0 THEN 'invalid_low_score' WHEN doc_id % 11 = 0 THEN 'missing' WHEN length(text) < 200 THEN 'too_short' ELSE 'success' END AS status, count(*) AS n FROM documents GROUP BY 1")
def export_ladder(spark, sf):
    score = F.when(F.col("doc_id") % 4 == 0, 0.2).when(F.col("doc_id") % 4 == 1, 0.9)
    text = F.when(F.col("doc_id") % 11 != 0, F.col("text"))
    return docs(spark, sf).groupBy(sinks.export_status(text, score).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("status_machine", "WITH s AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'unfinished' WHEN 2 THEN 'failed' ELSE 'corrupted' END AS status, CASE page_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'corrupted' ELSE 'timeout' END AS outcome FROM pages) SELECT CASE WHEN status = 'success' THEN status WHEN outcome = 'success' THEN 'success' WHEN outcome = 'corrupted' THEN 'corrupted' ELSE 'failed' END AS status, count(*) AS n FROM s GROUP BY 1")
def status_machine(spark, sf):
    k, o = F.col("page_id") % 4, F.col("page_id") % 3
    status = F.when(k == 0, "success").when(k == 1, "unfinished").when(k == 2, "failed").otherwise("corrupted")
    outcome = F.when(o == 0, "success").when(o == 1, "corrupted").otherwise("timeout")
    return table(spark, sf, "pages").groupBy(incremental.next_status(status, outcome).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("summary_counts", "SELECT count(*) AS total, count(DISTINCT lang) AS n_lang, count(DISTINCT source) AS n_source FROM documents")
def summary_counts(spark, sf):
    s = sinks.summary_json(docs(spark, sf), ["lang", "source"]).select(F.from_json("summary", "total long, lang map<string,long>, source map<string,long>").alias("s"))
    return s.select("s.total", F.size("s.lang").cast("long").alias("n_lang"), F.size("s.source").cast("long").alias("n_source"))


@query("windowed_events", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def windowed_events(spark, sf):
    return incremental.windowed_counts(table(spark, sf, "events")).withColumn("total", F.round("total", 2))


@query("stream_incremental", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_incremental(spark, sf):
    """Ingest the landed events twice by a checkpointed stream; the sink has each once."""
    base = shared_folder(spark, "stream")
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    events.write.parquet(f"{base}/landing")
    for _ in range(2):
        incremental.ingest(spark, f"{base}/landing", events.schema, f"{base}/sink", f"{base}/checkpoint", "event_id", "event_id")
    return spark.read.parquet(f"{base}/sink").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


