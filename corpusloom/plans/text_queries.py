"""Queries of scalar text functions and of web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import pagetree
from ..functions import text as T
from ..operators import chunks, tables
from ..sources import readers, sinks
from . import fixture as X
from .registry import query, table
from .shared import shared_folder

DOCS = "coalesce(text, '')"


def docs(spark, sf):
    return table(spark, sf, "documents")


STAMPED = "documents with a year written into text and name"


def stamped(spark, sf):
    """Every third text begins with a year, every other name holds one."""
    y = (F.lit(2010) + F.col("doc_id") % 20).cast("string")
    d = docs(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(y, F.lit(" "), F.col("t"))).otherwise(F.col("t")).alias("body"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("act_32"), y, F.lit("R.txt"))).otherwise(F.lit("act.txt")).alias("name"))


STAMPED_SQL = """s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (2010 + doc_id % 20)::VARCHAR || ' ' || t ELSE t END AS body,
 CASE WHEN doc_id % 2 = 0 THEN 'act_32' || (2010 + doc_id % 20)::VARCHAR || 'R.txt' ELSE 'act.txt' END AS name
 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
y AS (SELECT doc_id, TRY_CAST(regexp_extract(body, '(?:^|[^0-9A-Za-z_])(201[7-9]|202[0-6])(?:[^0-9A-Za-z_]|$)', 1) AS INT) AS by_body,
 TRY_CAST(regexp_extract(name, '(201[7-9]|202[0-6])', 1) AS INT) AS by_name FROM s)"""


@query("year_from_text", f"WITH {STAMPED_SQL} SELECT doc_id, by_body AS year FROM y")
def year_from_text(spark, sf):
    return stamped(spark, sf).select("doc_id", T.year_in_body(F.col("body")).alias("year"))


@query(
    "year_cascade",
    f"WITH {STAMPED_SQL} SELECT doc_id, coalesce(coalesce(by_body, by_name)::VARCHAR, 'unknown_year') AS year, CASE WHEN by_body IS NOT NULL THEN 'body' WHEN by_name IS NOT NULL THEN 'filename' ELSE 'none' END AS method FROM y",
)
def year_cascade(spark, sf):
    year, method = T.year_cascade(F.col("body"), F.col("name"))
    return stamped(spark, sf).select("doc_id", year.alias("year"), method.alias("method"))


@query("year_partition_counts", f"WITH {STAMPED_SQL} SELECT coalesce(coalesce(by_body, by_name)::VARCHAR, 'unknown_year') AS year, count(*) AS n FROM y GROUP BY 1")
def year_partition_counts(spark, sf):
    year, _ = T.year_cascade(F.col("body"), F.col("name"))
    return stamped(spark, sf).groupBy(year.alias("year")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("year") == "unknown_year", "year")


DATES = "CASE doc_id % 6 WHEN 0 THEN (2012 + doc_id % 17)::VARCHAR || '-06-14' WHEN 1 THEN (2012 + doc_id % 17)::VARCHAR || '/06/14' WHEN 2 THEN (2012 + doc_id % 17)::VARCHAR WHEN 3 THEN '12 March ' || (2012 + doc_id % 17)::VARCHAR WHEN 4 THEN (2012 + doc_id % 17)::VARCHAR || '-06-14T10:00:00' ELSE '' END"


@query(
    "date_fields",
    f"""WITH d AS (SELECT doc_id, {DATES} AS d FROM documents),
e AS (SELECT *, TRY_CAST(coalesce(nullif(regexp_extract(d, '([0-9]{{4}})[-/][0-9]{{2}}[-/][0-9]{{2}}', 1), ''), nullif(regexp_extract(d, '([0-9]{{4}})', 1), '')) AS INT) AS y, regexp_extract(d, '([0-9]{{4}})', 1) AS y4,
 regexp_extract(d, '([0-9]{{4}})[-/]([0-9]{{2}})[-/]([0-9]{{2}})', 1) || regexp_extract(d, '([0-9]{{4}})[-/]([0-9]{{2}})[-/]([0-9]{{2}})', 2) || regexp_extract(d, '([0-9]{{4}})[-/]([0-9]{{2}})[-/]([0-9]{{2}})', 3) AS ymd FROM d)
SELECT doc_id, regexp_extract(d, '^([0-9]{{4}})', 1) AS year_prefix, CASE WHEN y BETWEEN 2017 AND 2026 THEN y END AS year_checked, CASE WHEN TRY_CAST(y4 AS INT) BETWEEN 2017 AND 2026 THEN y4 ELSE 'unknown' END AS year_or_unknown,
 CASE WHEN ymd <> '' THEN ymd WHEN y4 <> '' THEN y4 || '0000' ELSE '00000000' END AS date_prefix, string_split(d, 'T')[1] AS day FROM e""",
)
def date_fields(spark, sf):
    y = (F.lit(2012) + F.col("doc_id") % 17).cast("string")
    kind = F.col("doc_id") % 6
    d = F.when(kind == 0, F.concat(y, F.lit("-06-14"))).when(kind == 1, F.concat(y, F.lit("/06/14"))).when(kind == 2, y).when(kind == 3, F.concat(F.lit("12 March "), y)).when(kind == 4, F.concat(y, F.lit("-06-14T10:00:00"))).otherwise("")
    d = docs(spark, sf).select("doc_id", d.alias("d"))
    c = F.col("d")
    return d.select("doc_id", T.year_prefix(c).alias("year_prefix"), T.year_of_date(c).alias("year_checked"), T.year_or_unknown(c, "unknown").alias("year_or_unknown"), T.date_prefix(c).alias("date_prefix"), T.day_of(c).alias("day"))


@query(
    "clean_text",
    r"""WITH a AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^ -~\n]', '', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, 'https?://[^ \t\n]+|www\.[^ \t\n]+', ' ', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '[^ \t\n]+@[^ \t\n]+\.[^ \t\n]+', ' ', 'g') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\b[Pp]age[ \t\n]*[0-9]+\b', ' ', 'g'), '\b[Pp]\.[ \t\n]*[0-9]+\b', ' ', 'g') AS t FROM c),
e AS (SELECT doc_id, regexp_replace(t, '(?m)^[ \t]*-+[ \t]*[0-9]+[ \t]*-+[ \t]*$', ' ', 'g') AS t FROM d),
f AS (SELECT doc_id, array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT (length(regexp_replace(trim(x), '[^a-zA-Z]', '', 'g')) < 3 AND length(trim(x)) > 5)), chr(10)) AS t FROM e),
g AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '(?m)^ ', '', 'g'), '(?m) $', '', 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g') AS t FROM f)
SELECT doc_id, CASE WHEN len(list_filter(regexp_split_to_array(t, '[ \t\n]+'), lambda x: x <> '')) >= 15 THEN t END AS cleaned FROM g""",
)
def clean_text(spark, sf):
    ascii_ = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^ -~\n]", "")
    return docs(spark, sf).select("doc_id", T.clean(ascii_).alias("cleaned"))


@query(
    "numeric_line_filter",
    f"SELECT doc_id, len(string_split({DOCS}, chr(10))) AS n_lines, len(list_filter(string_split({DOCS}, chr(10)), lambda x: length(regexp_replace(trim(x, ' '), '[^a-zA-Z]', '', 'g')) < 3 AND length(trim(x, ' ')) > 5)) AS n_numeric FROM documents",
)
def numeric_line_filter(spark, sf):
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return docs(spark, sf).select("doc_id", F.size(lines).alias("n_lines"), F.size(F.filter(lines, T.numeric_row)).alias("n_numeric"))


WORDS = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''))"


@query("fragment_filter", f"SELECT doc_id, {WORDS} AS n_words, {WORDS} >= 20 AS long_enough FROM documents WHERE {WORDS} >= 15")
def fragment_filter(spark, sf):
    n = T.word_count(F.col("text"))
    return docs(spark, sf).select("doc_id", n.alias("n_words"), (n >= 20).alias("long_enough")).where("n_words >= 15")


@query(
    "pii_redact",
    r"""WITH a AS (SELECT doc_id, 'Contact: Anna Berg Office : B12/34 ' || regexp_replace(coalesce(text, ''), '[^ -~\n]', '', 'g') AS t FROM documents WHERE text LIKE '%@%' OR regexp_matches(text, '[0-9]{3}'))
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', '[EMAIL]', 'g'),
 '\+?[0-9]{1,4}[\s.-]?\(?[0-9]{1,4}\)?[\s.-]?[0-9]{2,4}[\s.-]?[0-9]{2,4}[\s.-]?[0-9]{2,4}', '[PHONE]', 'g'), '(Contact|Responsible)\s*:\s*[A-Z][a-z]+(?:\s[A-Z][a-z]+)+', '\1: [REDACTED]', 'g'), 'Office\s*:\s*[A-Z]+[0-9]*[-/][0-9]+', 'Office: [REDACTED]', 'g') AS redacted FROM a""",
)
def pii_redact(spark, sf):
    ascii_ = F.concat(F.lit("Contact: Anna Berg Office : B12/34 "), F.regexp_replace(F.coalesce("text", F.lit("")), r"[^ -~\n]", ""))
    some = F.contains("text", F.lit("@")) | F.col("text").rlike("[0-9]{3}")
    return docs(spark, sf).where(some).select("doc_id", T.redact(ascii_).alias("redacted"))


@query(
    "header_parse",
    """WITH s AS (SELECT doc_id, source, text FROM documents)
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE coalesce(source, '') END AS source, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'second' END AS theme,
 CASE WHEN doc_id % 5 = 0 THEN 'TITLE: x' || chr(10) || repeat('=', 80) || chr(10) ELSE '' END || coalesce(text, '') AS body FROM s""",
)
def header_parse(spark, sf):
    plain = F.coalesce("text", F.lit(""))
    rule = "=" * 80
    layout_a = F.concat(F.lit("Topic (EN): first\nSource: "), F.coalesce("source", F.lit("")), F.lit(f"\nTopic (EN): second\n{rule}\n"), plain)
    layout_b = F.concat(F.lit(f"{rule}\nTITLE: x\n{rule}\n"), plain)
    d = docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 5 == 0, layout_b).otherwise(layout_a).alias("t"))
    fields, body = T.header_fields(F.col("t"))
    get = lambda k: F.coalesce(F.try_element_at("f", F.lit(k)), F.lit(""))
    return d.select("doc_id", fields.alias("f"), body.alias("body")).select("doc_id", get("Source").alias("source"), get("Topic (EN)").alias("theme"), "body")


@query(
    "html_title",
    """SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')), ''),
 nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')), '')) AS title FROM pages""",
)
def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.page_title(F.col("html")).alias("title"))


@query(
    "page_date",
    """WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '<meta name="DC.date" content="2021-03-04T00:00">' WHEN 1 THEN '<time class="x" datetime="2020-05-06 10:00">' WHEN 3 THEN '<p title="01.02.2003">Published <b>14</b>.06.2021, not 15.07.2022</p>' ELSE '' END || html AS html,
 url || CASE WHEN page_id % 5 >= 2 THEN '-2019-07-08_en' ELSE '' END AS url FROM pages),
m AS (SELECT page_id, html, url, list_filter(regexp_extract_all(html, '(?i)<meta\\b[^>]*>'), lambda t: lower(regexp_extract(t, '(?i)\\bname="([^"]*)"', 1)) IN ('dc.date', 'dcterms.issued', 'publication-date', 'date')
 AND regexp_matches(t, '(?i)\\bcontent="[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS tags,
 regexp_extract(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<[^<>]*>', '', 'g'), '[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}') AS d FROM p)
SELECT page_id, coalesce(nullif(regexp_extract(tags[1], '(?i)\\bcontent="([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), ''), nullif(regexp_extract(html, '(?i)<time\\b[^>]*\\bdatetime="([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), ''),
 CASE WHEN d <> '' THEN d[7:10] || '-' || d[4:5] || '-' || d[1:2] END, nullif(regexp_extract(url, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), ''), '') AS published FROM m""",
)
def page_date(spark, sf):
    """Every fifth page carries a meta tag, a time element, a date in its address alone, a date in its text, or an address again."""
    k = F.col("page_id") % 5
    carried = F.when(k == 0, '<meta name="DC.date" content="2021-03-04T00:00">').when(k == 1, '<time class="x" datetime="2020-05-06 10:00">').when(k == 3, '<p title="01.02.2003">Published <b>14</b>.06.2021, not 15.07.2022</p>')
    html = F.concat(carried.otherwise(""), "html")
    url = F.concat("url", F.when(k >= 2, "-2019-07-08_en").otherwise(""))
    return table(spark, sf, "pages").select("page_id", T.page_date(html, url).alias("published"))


TAILS = [" | European Commission", " - EU portal", " - a short guide", " | European Union - news"]


@query(
    "site_title",
    """WITH t AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS t FROM pages)
SELECT page_id, nullif(trim(regexp_replace(t || [' | European Commission', ' - EU portal', ' - a short guide', ' | European Union - news'][1 + page_id % 4], '\\s*[-|]\\s*(European Commission|EU|European Union).*$', '')), '') AS title,
 regexp_replace(url || CASE page_id % 4 WHEN 0 THEN '?s=12' WHEN 1 THEN '&s=7' ELSE '' END, '[?&]s=[0-9]+$', '') AS address FROM t""",
)
def site_title(spark, sf):
    """Titles that carry a site's name or a part of their own, without the former; addresses without a session number."""
    title = T.squeeze(F.regexp_replace(F.regexp_extract("html", r"(?s)<title[^>]*>(.*?)</title>", 1), "<[^>]*>", ""))
    carried = F.concat(title, F.element_at(F.array(*map(F.lit, TAILS)), (F.col("page_id") % 4 + 1).cast("int")))
    url = F.concat("url", F.when(F.col("page_id") % 4 == 0, "?s=12").when(F.col("page_id") % 4 == 1, "&s=7").otherwise(""))
    return table(spark, sf, "pages").select("page_id", T.or_null(F.trim(T.drop_site(carried))).alias("title"), T.drop_session(url).alias("address"))


@query("html_links", """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages""")
def html_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(T.links(F.col("html"))).alias("link"))


NESTED = ['<article><div class="a ecl-message">x<div>y</div>z</div>', '<div role="main"><article>', '<main><nav>u<nav>v</nav>w</nav>', '<article><header>r</header><p id="skip-link">s</p>']
IN_PAGE = ("main", "#main-content", ".main-content", "[role=main]", "article", "body")


@query(
    "html_text",
    r"""WITH p AS (SELECT page_id, replace(html, '<article>', ['<article><div class="a ecl-message">x<div>y</div>z</div>', '<div role="main"><article>', '<main><nav>u<nav>v</nav>w</nav>', '<article><header>r</header><p id="skip-link">s</p>'][1 + page_id % 4]) AS html FROM pages),
k AS (SELECT page_id, unnest(t) AS t, generate_subscripts(t, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<!--.*?-->|<![^<>]*>|<script\b[^<>]*>.*?</script>|<style\b[^<>]*>.*?</style>|<[^<>]*>|[^<]+') AS t FROM p)),
g AS (SELECT *, lower(regexp_extract(t, '^</?([a-zA-Z][^\s<>/]*)', 1)) AS name, CASE WHEN t LIKE '</%' THEN -1 WHEN regexp_matches(t, '(?i)^<(meta|br|img|link|hr|script|style)\b') THEN 0 ELSE 1 END AS kind FROM k),
tag AS (SELECT *, sum(kind) OVER (PARTITION BY page_id, name ORDER BY i) + CASE WHEN kind = -1 THEN 1 ELSE 0 END AS level FROM g WHERE name <> '' AND kind <> 0),
el AS (SELECT o.page_id, o.name, o.t, o.i, coalesce(min(c.i), 1000000000) AS e FROM tag o LEFT JOIN tag c ON c.page_id = o.page_id AND c.name = o.name AND c.level = o.level AND c.kind = -1 AND c.i > o.i WHERE o.kind = 1 GROUP BY ALL),
chrome AS (SELECT * FROM el WHERE name IN ('nav', 'footer', 'noscript', 'iframe', 'svg', 'header', 'button', 'select') OR regexp_matches(t, 'class="([^"]* )?ecl-message[ "]') OR t LIKE '%id="skip-link"%'),
box AS (SELECT el.*, CASE WHEN name = 'main' THEN 'main' WHEN t LIKE '%role="main"%' THEN '[role=main]' ELSE name END AS selector, CASE WHEN name = 'main' THEN 1 WHEN t LIKE '%role="main"%' THEN 4 WHEN name = 'article' THEN 5 ELSE 6 END AS rank
 FROM el WHERE (name IN ('main', 'article', 'body') OR t LIKE '%role="main"%') AND NOT EXISTS (SELECT 1 FROM chrome c WHERE c.page_id = el.page_id AND c.i <= el.i AND el.i < c.e)),
best AS (SELECT * FROM box QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rank, i) = 1),
node AS (SELECT g.page_id, g.i, g.t, EXISTS (SELECT 1 FROM chrome c WHERE c.page_id = g.page_id AND c.i < g.i AND g.i < c.e) AS out FROM g WHERE name = '' AND t NOT LIKE '<%'),
raw AS (SELECT page_id, sum(length(regexp_extract(t, '(?is)^<[^<>]*>(.*)</', 1))) AS n FROM k WHERE regexp_matches(t, '(?i)^<(script|style)\b') GROUP BY 1),
plain AS (SELECT page_id, i, out, length(t) AS n, regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&middot;', '·'), '&amp;', '&'), '^\s+|\s+$', '', 'g') AS t FROM node)
SELECT b.page_id, any_value(b.selector) AS container, coalesce(any_value(raw.n), 0)::BIGINT + coalesce(sum(n.n) FILTER (n.out), 0)::BIGINT AS removed,
 regexp_replace(coalesce(string_agg(n.t, chr(10) ORDER BY n.i) FILTER (NOT n.out AND n.t <> '' AND n.i > b.i AND n.i < b.e), ''), '[ \t]{2,}', ' ', 'g') AS text
FROM best b LEFT JOIN plain n USING (page_id) LEFT JOIN raw USING (page_id) GROUP BY b.page_id""",
)
def html_text(spark, sf):
    """Pages that carry nested chrome or containers, by their tree."""
    html = F.replace("html", F.lit("<article>"), F.element_at(F.array(*map(F.lit, NESTED)), (F.col("page_id") % 4 + 1).cast("int")))
    pages = table(spark, sf, "pages").select("page_id", html.alias("html"))
    return pagetree.with_content(pages, containers=IN_PAGE).select("page_id", "container", "removed", "text")


@query(
    "structure_counts",
    """WITH t AS (SELECT page_id, 'Article 1 ANNEX I ' || html AS t FROM pages)
SELECT page_id, len(regexp_extract_all(t, 'Article\\s+[0-9]+')) AS article_count, len(regexp_extract_all(t, 'ANNEX\\s+[IVX0-9]')) AS annex_count, len(regexp_extract_all(t, '[Ff]ootnote')) AS footnote_count,
 CASE WHEN length(t) < 500 AND len(regexp_extract_all(t, 'Article\\s+[0-9]+')) = 0 THEN 'LOW_CONTENT' ELSE 'YES' END AS structure_complete FROM t""",
)
def structure_counts(spark, sf):
    t = F.concat(F.lit("Article 1 ANNEX I "), F.col("html"))
    n = T.structure(t)
    return table(spark, sf, "pages").select("page_id", *[c.alias(k) for k, c in n.items()], T.structure_verdict(t, n["article_count"]).alias("structure_complete"))


@query(
    "url_parts",
    """WITH u AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS depth, path LIKE '/en/%' AND len(list_filter(string_split(path, '/'), lambda x: x <> '')) >= 2 AS wanted,
 regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/x/y' AS absolute_link FROM u JOIN pages USING (page_id)""",
)
def url_parts(spark, sf):
    u = F.col("url")
    path = T.url_path(u)
    return table(spark, sf, "pages").select("page_id", T.url_host(u).alias("host"), path.alias("path"), T.url_depth(u).alias("depth"), (path.startswith("/en/") & (T.url_depth(u) >= 2)).alias("wanted"), T.absolute(u, F.lit("/x/y")).alias("absolute_link"))


@query("doc_id_hash", "SELECT page_id, substr(md5(trim(url)), 1, 12) AS md5_id, substr(sha256(url || '|t|2024'), 1, 12) AS sha_id, sha256(html) AS file_hash FROM pages")
def doc_id_hash(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.short_md5(F.col("url")).alias("md5_id"), T.short_sha256(F.col("url"), F.lit("t"), F.lit("2024")).alias("sha_id"), F.sha2("html", 256).alias("file_hash"))


@query("safe_filename", r"""SELECT page_id, regexp_replace(substr(regexp_replace(regexp_replace(url, '^https?://', ''), '[\\/:*?"<>|]', '_', 'g'), 1, 24), '^_+|_+$', '', 'g') AS name FROM pages""")
def safe_filename(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.safe_name(F.col("url"), 24).alias("name"))


@query(
    "document_block",
    """SELECT doc_id, 'Id: ' || doc_id::VARCHAR || chr(10) || 'Source: ' || coalesce(source, '') || chr(10) || repeat('=', 70) || chr(10) || coalesce(text, '') AS block FROM documents""",
)
def document_block(spark, sf):
    return docs(spark, sf).select("doc_id", sinks.document_block([("Id", F.col("doc_id")), ("Source", F.col("source"))], F.col("text")).alias("block"))


@query(
    "sparql_bindings",
    """WITH p AS (SELECT (page_id // 2)::VARCHAR AS id, url AS title, page_id FROM pages WHERE page_id % 7 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY page_id) AS n FROM p)
SELECT id, title, '' AS date FROM r WHERE n = 1""",
)
def sparql_bindings(spark, sf):
    value = lambda c: F.struct(c.alias("value"))
    id_ = F.when(F.col("page_id") % 7 != 0, F.floor(F.col("page_id") / 2).cast("string")).otherwise("")
    one = F.struct(value(id_).alias("id"), value(F.col("url")).alias("title"), F.lit(None).cast("struct<value:string>").alias("date"))
    p = table(spark, sf, "pages").select("page_id", one.alias("b"), F.floor(F.col("page_id") / 500).alias("page"))
    p = p.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("page_id", "b"))).alias("all"))  # answers of 500 rows
    landed = p.select("page", F.to_json(F.struct(F.struct(F.transform("all", lambda x: x["b"]).alias("bindings")).alias("results"))).alias("json"))
    parsed = landed.select("page", F.from_json("json", readers.bindings_schema(["id", "title", "date"])).alias("j")).select("page", "j.*")
    return readers.decode_bindings(parsed, ["id", "title", "date"], "id", order=["page"])


@query("sitemap_entries", "SELECT url, '2024-01-' || lpad((1 + page_id % 28)::VARCHAR, 2, '0') AS lastmod FROM pages")
def sitemap_entries(spark, sf):
    entry = F.concat(F.lit("<url><loc> "), F.col("url"), F.lit(" </loc><lastmod>2024-01-"), F.lpad((1 + F.col("page_id") % 28).cast("string"), 2, "0"), F.lit("</lastmod></url>"))
    maps = table(spark, sf, "pages").groupBy(F.floor(F.col("page_id") / 500).alias("m")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(entry), "\n"), F.lit("</urlset>")).alias("xml"))
    return readers.sitemap_rows(maps).select("url", "lastmod")


@query(
    "sitemap_tree",
    """WITH RECURSIVE edges AS (SELECT 'map' || (page_id // 9)::VARCHAR AS parent, 'map' || page_id::VARCHAR AS child, row_number() OVER (PARTITION BY page_id // 9 ORDER BY page_id) AS n FROM pages WHERE page_id > 0),
tree AS (SELECT 'map0' AS m, 0 AS depth UNION ALL SELECT child, depth + 1 FROM tree JOIN edges ON parent = m WHERE n <= 4 AND depth < 2)
SELECT 'https://example.com/' || m AS url, '2024-02-03' AS lastmod, depth FROM tree""",
)
def sitemap_tree(spark, sf):
    """Landed sitemaps, an index of sitemaps each: page k is listed by page k // 9. Two levels below the root, four children each."""
    own = F.format_string("<url><loc>https://example.com/map%d</loc><lastmod>2024-02-03</lastmod></url>", F.col("page_id"))
    child = F.struct("page_id", F.format_string("<sitemap><loc>map%d</loc></sitemap>", F.col("page_id")).alias("x"))
    p = table(spark, sf, "pages").select("page_id")
    below = p.where("page_id > 0").groupBy(F.floor(F.col("page_id") / 9).alias("page_id")).agg(F.array_sort(F.collect_list(child)).alias("c"))
    xml = F.concat(own, F.coalesce(F.array_join(F.transform("c", lambda c: c["x"]), ""), F.lit("")))
    landed = p.join(below, "page_id", "left").select(F.format_string("map%d", F.col("page_id")).alias("map"), xml.alias("xml"))
    return readers.sitemap_tree(landed, "map0", lambda: shared_folder(spark, "maps"), depth=2, children=4)


@query("fetch_outcomes", "SELECT CASE WHEN page_id % 5 = 0 THEN 'missing' WHEN page_id % 5 = 1 THEN 'retry' WHEN length(html) > 50 THEN 'success' ELSE 'failed' END AS outcome, count(*) AS n FROM pages GROUP BY 1")
def fetch_outcomes(spark, sf):
    status = F.when(F.col("page_id") % 5 == 0, 404).when(F.col("page_id") % 5 == 1, 503).otherwise(200)
    return table(spark, sf, "pages").groupBy(readers.fetch_outcome(status, F.length("html")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("chunk_documents")
def chunk_documents(spark, sf):
    out = chunks.chunked(docs(spark, sf), ["doc_id"])
    return tables.keep_first(out.withColumn("text_key", F.md5("text")), ["text_key"], ["doc_id", "chunk_no"]).drop("text_key")


@query(
    "token_quantiles",
    f"SELECT min(n) AS low, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS q75, max(n) AS high, round(avg(n), 4) AS mean FROM (SELECT {WORDS} AS n FROM documents)",
)
def token_quantiles(spark, sf):
    n = docs(spark, sf).select(T.word_count(F.col("text")).alias("n"))
    q = lambda p: F.percentile("n", p)
    return n.agg(F.min("n").alias("low"), q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"), F.max("n").alias("high"), F.round(F.avg("n"), 4).alias("mean"))


@query("softmax_confidence", "WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)) AS e FROM embeddings) SELECT vec_id, round(list_max(e) / list_sum(e), 4) AS confidence, list_position(e, list_max(e)) - 1 AS label FROM s")
def softmax_confidence(spark, sf):
    p = T.softmax(F.transform("embedding", lambda x: x.cast("double")))
    d = table(spark, sf, "embeddings").select("vec_id", p.alias("p"))
    return d.select("vec_id", F.round(F.array_max("p"), 4).alias("confidence"), (F.array_position("p", F.array_max("p")) - 1).alias("label"))


@query(
    "seed_hop",
    """WITH l AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS link FROM pages),
d AS (SELECT DISTINCT page_id, link FROM l WHERE lower(regexp_extract(link, '^[a-z]+://([^/?#]+)', 1)) = host),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY link) AS n FROM d) SELECT page_id, link FROM r WHERE n <= 3""",
)
def seed_hop(spark, sf):
    """The first three internal links of every seed page, in order."""
    found = table(spark, sf, "pages").select("page_id", "url", F.explode(T.links(F.col("html"))).alias("raw")).where(F.col("raw").startswith("/"))
    found = found.select("page_id", T.url_host(F.col("url")).alias("host"), T.absolute(F.col("url"), F.col("raw")).alias("link"))
    inside = found.where(T.url_host(F.col("link")) == F.col("host")).select("page_id", "link").distinct()
    return tables.top_n(inside, ["page_id"], ["link"], 3)


@query("pdf_links", "SELECT page_id, regexp_matches(lower(url || CASE WHEN page_id % 3 = 0 THEN '/a.PDF?x=1' WHEN page_id % 3 = 1 THEN '/download/7' ELSE '' END), '\\.pdf(\\?.*)?$|_en\\.pdf|/download/') AS is_pdf FROM pages")
def pdf_links(spark, sf):
    tail = F.when(F.col("page_id") % 3 == 0, "/a.PDF?x=1").when(F.col("page_id") % 3 == 1, "/download/7").otherwise("")
    return table(spark, sf, "pages").select("page_id", T.is_pdf_link(F.concat("url", tail)).alias("is_pdf"))


@query("share_bars", "WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT lang, n, repeat('#', floor(n::DOUBLE / (SELECT sum(n) FROM n) * 40)::INT) AS bar FROM n")
def share_bars(spark, sf):
    n = docs(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("all")))).select("lang", "n", T.share_bar(F.col("n").cast("double") / F.col("all")).alias("bar"))


@query("keyword_patterns", None)
def keyword_patterns(spark, sf):
    """Documents by keyword form: the stem patterns of the fixture lexicon."""
    low = F.lower(F.coalesce("text", F.lit("")))
    n = F.array(*[F.struct(F.lit(k).alias("keyword"), low.rlike(L.java(L.keyword_pattern(k))).alias("hit")) for _, _, k in X.ROWS])
    return docs(spark, sf).select(F.explode(n).alias("h")).groupBy("h.keyword").agg(F.count_if("h.hit").alias("n_docs"))
