"""Scalar text functions as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR = 2017, 2026
IN_RANGE = r"(201[7-9]|202[0-6])"
UNSAFE = r'[\\/:*?"<>|]'


def or_null(c: Column) -> Column:
    return F.when(c != "", c)


def squeeze(c: Column) -> Column:
    """One blank for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def word_count(c: Column) -> Column:
    """Words between ASCII white space; 0 for null and blank."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0))


# Years and dates


def year_in_body(c: Column) -> Column:
    """First free-standing year in range, as int."""
    return F.regexp_extract(c, rf"(?:^|[^0-9A-Za-z_]){IN_RANGE}(?![0-9A-Za-z_])", 1).try_cast("int")


def year_in_name(c: Column) -> Column:
    """Leftmost year in range anywhere in a file name."""
    return F.regexp_extract(c, IN_RANGE, 1).try_cast("int")


def year_cascade(body: Column, name: Column) -> tuple[Column, Column]:
    """(year or the sentinel, the method that found it): body first, then file name."""
    b, n = year_in_body(body), year_in_name(name)
    year = F.coalesce(b, n).cast("string")
    method = F.when(b.isNotNull(), "body").when(n.isNotNull(), "filename").otherwise("none")
    return F.coalesce(year, F.lit("unknown_year")), method


def year_prefix(c: Column) -> Column:
    """The four digits a date starts with, unchecked; '' otherwise."""
    return F.regexp_extract(c, r"^([0-9]{4})", 1)


def year_of_date(c: Column) -> Column:
    """ISO or slash date first, then any four digits; null out of range."""
    y = F.coalesce(or_null(F.regexp_extract(c, r"([0-9]{4})[-/][0-9]{2}[-/][0-9]{2}", 1)), or_null(F.regexp_extract(c, r"([0-9]{4})", 1))).try_cast("int")
    return F.when(y.between(FIRST_YEAR, LAST_YEAR), y)


def year_or_unknown(c: Column, unknown: str) -> Column:
    y = F.regexp_extract(c, r"([0-9]{4})", 1).try_cast("int")
    return F.when(y.between(FIRST_YEAR, LAST_YEAR), y.cast("string")).otherwise(unknown)


def date_prefix(c: Column) -> Column:
    """YYYYMMDD of an ISO or slash date, YYYY0000 of a bare year, 00000000 otherwise."""
    full = r"([0-9]{4})[-/]([0-9]{2})[-/]([0-9]{2})"
    whole = F.concat(F.regexp_extract(c, full, 1), F.regexp_extract(c, full, 2), F.regexp_extract(c, full, 3))
    year = F.regexp_extract(c, r"([0-9]{4})", 1)
    return F.when(whole != "", whole).when(year != "", F.concat(year, F.lit("0000"))).otherwise("00000000")


def day_of(c: Column) -> Column:
    """A timestamp string up to its T."""
    return F.substring_index(c, "T", 1)


# Ids and names


def short_md5(c: Column) -> Column:
    return F.substring(F.md5(F.trim(c)), 1, 12)


def short_sha256(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)


def safe_name(c: Column, most: int = 80) -> Column:
    """A file name: scheme and unsafe characters out, at most `most` characters, no _ at the ends."""
    bare = F.regexp_replace(c, r"^https?://", "")
    cut = F.substring(F.regexp_replace(bare, UNSAFE, "_"), 1, most)
    return F.regexp_replace(cut, r"^_+|_+$", "")


# Cleaning


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed a single time, however often f names it."""
    return F.transform(F.array(c), f)[0]


def drop_links(c: Column) -> Column:
    return F.regexp_replace(c, r"https?://\S+|www\.\S+", " ")


def drop_emails(c: Column) -> Column:
    """Words that hold an @ behind their first character and a dot behind that, each replaced by a blank. One attempt a word, so the time is linear."""
    return once(c, lambda t: F.when(F.contains(t, F.lit("@")), F.regexp_replace(t, r"(?<!\S)\S[^\s@]*+@\S\S*\.\S+", " ")).otherwise(t))


def drop_page_marks(c: Column) -> Column:
    c = F.regexp_replace(c, r"\b[Pp]age\s*[0-9]+\b", " ")
    c = F.regexp_replace(c, r"\b[Pp]\.\s*[0-9]+\b", " ")
    return F.regexp_replace(c, r"(?m)^[ \t]*[-–—]+[ \t]*[0-9]+[ \t]*[-–—]+[ \t]*$", " ")


def numeric_row(line: Column) -> Column:
    """A table row: more than five characters and fewer than three ASCII letters."""
    t = F.trim(line)
    return (F.length(t) > 5) & ~t.rlike("(?:[a-zA-Z][^a-zA-Z]*+){2}[a-zA-Z]")


def drop_numeric_rows(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~numeric_row(x)), "\n")


def tidy_space(c: Column) -> Column:
    c = F.replace(c, F.lit("\r\n"), F.lit("\n"))
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"(?m)^ ", "")
    c = F.regexp_replace(c, r"(?m) $", "")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean(c: Column, least: int = 15) -> Column:
    """The cleaned text, null if it has fewer than `least` words."""
    t = tidy_space(drop_numeric_rows(drop_page_marks(drop_emails(drop_links(c)))))
    return once(t, lambda x: F.when(x.rlike(rf"^\s*+(?:\S++\s++){{{least - 1}}}\S"), x)) if least > 0 else t


# Personal data in fixed order: the phone rule runs before the contact rules. Fixed values.
REDACTIONS = [
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL]"),
    (r"\+?[0-9]{1,4}[\s.-]?\(?[0-9]{1,4}\)?[\s.-]?[0-9]{2,4}[\s.-]?[0-9]{2,4}[\s.-]?[0-9]{2,4}", "[PHONE]"),
    (r"(Contact|Responsible)\s*:\s*[A-Z][a-z]+(?:\s[A-Z][a-z]+)+", "$1: [REDACTED]"),
    (r"Office\s*:\s*[A-Z]+[0-9]*[-/][0-9]+", "Office: [REDACTED]"),
]


def redact(c: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    for pattern, to in rules or REDACTIONS:
        c = F.regexp_replace(c, pattern, to)
    return c


# Web pages


def page_date(html: Column, url: Column) -> Column:
    """Publication date (YYYY-MM-DD): the first dated meta tag of a known name, else the first dated time element, else the first
    DD.MM.YYYY of the page's text, else a date in the address, else empty."""
    day = r"([0-9]{4}-[0-9]{2}-[0-9]{2})"
    tags = F.transform(
        F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0)),
        lambda t: F.when(F.lower(F.regexp_extract(t, r'(?i)\bname="([^"]*)"', 1)).isin(*DATE_NAMES), or_null(F.regexp_extract(t, rf'(?i)\bcontent="{day}', 1))),
    )
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^<>]*>", "")
    written = r"([0-9]{2})\.([0-9]{2})\.([0-9]{4})"
    in_text = F.concat_ws("-", *[or_null(F.regexp_extract(text, written, k)) for k in (3, 2, 1)])
    in_meta, in_time = F.try_element_at(F.filter(tags, lambda d: d.isNotNull()), F.lit(1)), F.regexp_extract(html, rf'(?i)<time\b[^>]*\bdatetime="{day}', 1)
    return F.coalesce(in_meta, or_null(in_time), or_null(in_text), F.regexp_extract(url, day, 1), F.lit(""))


# Names of meta tags that hold a date of publication.
DATE_NAMES = ("dc.date", "dcterms.issued", "publication-date", "date")


def page_title(html: Column) -> Column:
    """First h1, then og:title, then title, without tags; null if none."""
    plain = lambda x: or_null(squeeze(F.regexp_replace(x, "<[^>]*>", "")))
    return F.coalesce(
        plain(F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1)),
        plain(F.regexp_extract(html, r'<meta property="og:title" content="([^"]*)"', 1)),
        plain(F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1)),
    )


# Names of sites that end a title.
SITES = ("European Commission", "EU", "European Union")


def drop_site(title: Column, sites: tuple[str, ...] = SITES) -> Column:
    """A title of one line up to the first - or | that a site's name follows."""
    return F.regexp_replace(title, rf"\s*[-|]\s*({'|'.join(map(re.escape, sites))}).*$", "")


def drop_session(url: Column) -> Column:
    """An address without a trailing session number `?s=NNN`."""
    return F.regexp_replace(url, r"[?&]s=[0-9]+$", "")


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]+)"'), F.lit(1))


def structure(text: Column) -> dict[str, Column]:
    """Counts of numbered articles, annexes and footnotes."""
    return {
        "article_count": F.regexp_count(text, F.lit(r"Article\s+[0-9]+")),
        "annex_count": F.regexp_count(text, F.lit(r"ANNEX\s+[IVX0-9]")),
        "footnote_count": F.regexp_count(text, F.lit(r"[Ff]ootnote")),
    }


def structure_verdict(text: Column, articles: Column) -> Column:
    return F.when(text.isNull(), "PARSE_ERROR").when((F.length(text) < 500) & (articles == 0), "LOW_CONTENT").otherwise("YES")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)


def url_depth(url: Column) -> Column:
    return F.size(F.filter(F.split(url_path(url), "/"), lambda x: x != ""))


def absolute(base: Column, link: Column) -> Column:
    """A link as seen from a page: absolute as it is, from the host's root, or below the page's folder."""
    root = F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(url_path(base), r"[^/]*$", "")
    return F.when(link.rlike("^[a-z]+:"), link).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))


def header_fields(text: Column, rule: str = "=" * 20) -> tuple[Column, Column]:
    """(map of `Key: value` lines above the first rule, text below it). The last of equal keys wins."""
    at = F.locate(rule, text)
    head = F.when(at > 1, F.substring(text, F.lit(1), at - 1)).otherwise(F.lit(""))
    below = F.when(at > 0, F.regexp_replace(F.substring(text, at, F.length(text)), r"^=+\n?", "")).otherwise(text)
    rows = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(rows, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substring(x, F.locate(":", x) + 1, F.length(x))).alias("value")))
    # Keep the last of each key: a pair goes if its key comes again later.
    kept = F.filter(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), p["value"].alias("value"), i.alias("i"))), lambda p: ~F.exists(F.slice(pairs, p["i"] + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(F.transform(kept, lambda p: F.struct(p["key"], p["value"]))), below


# Probabilities


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def share_bar(share: Column, width: int = 40) -> Column:
    """A share of one as a bar of #."""
    return F.repeat(F.lit("#"), F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * width).cast("int"))


def is_pdf_link(link: Column) -> Column:
    """A link to a PDF: by suffix, by language suffix or by a download path."""
    return F.lower(link).rlike(r"\.pdf(\?.*)?$|_en\.pdf|/download/")
