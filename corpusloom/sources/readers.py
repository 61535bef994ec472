"""Scans: CSV, text, JSON state, landed SPARQL results, sitemaps, binary files. Missing values become null at the scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import header_fields, year_in_name
from ..operators.frontier import crawl
from ..operators.tables import keep_first, keep_last, require

BINDING = "value: string"


def read_csv(spark: SparkSession, path: str, schema: StructType | str, required: list[str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A CSV with header, quoted line breaks and an optional byte-order mark."""
    df = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', encoding=encoding, maxCharsPerColumn=-1, enforceSchema=True)
    return require(df, required or [])


def read_csv_any(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """As UTF-8; as Latin-1 where that leaves replacement characters."""
    df = read_csv(spark, path, schema)
    text = [c for c, kind in df.dtypes if kind == "string"]
    broken = F.lit(False)
    for c in text:
        broken = broken | F.coalesce(F.contains(F.col(c), F.lit("�")), F.lit(False))
    return read_csv(spark, path, schema, encoding="ISO-8859-1") if df.where(broken).limit(1).count() else df


def read_keyed_csv(spark: SparkSession, path: str, schema: StructType | str, key: str) -> DataFrame:
    """The last row of each key in file order."""
    df = read_csv(spark, path, schema).withColumn("_ord", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    return keep_last(df, [key], "_ord").drop("_ord")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, text): every *.txt of a folder; bytes that are not UTF-8 are dropped."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    text = F.replace(F.try_validate_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    fallback = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.coalesce(text, fallback).alias("text"))


def corpus_rows(texts: DataFrame) -> DataFrame:
    """(text, year, source, theme) of text files: header above the first rule; the year falls back to the file name."""
    fields, body = header_fields(F.col("text"))
    d = texts.select("file_name", fields.alias("f"), body.alias("body"))
    get = lambda k: F.coalesce(F.try_element_at("f", F.lit(k)), F.lit(""))
    year = F.coalesce(F.when(get("Year") != "", get("Year")), year_in_name(F.col("file_name")).cast("string"), F.lit(""))
    return d.select(F.regexp_replace("body", r"^\s+|\s+$", "").alias("text"), year.alias("year"), get("Source").alias("source"), get("Topic (EN)").alias("theme")).where("text <> ''")


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON state file; a missing or broken one is empty."""
    try:
        df = spark.read.schema(schema + ", _corrupt_record string").json(path, multiLine=True, mode="PERMISSIVE").cache()
        return df.where("_corrupt_record is null").drop("_corrupt_record")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def decode_bindings(results: DataFrame, names: list[str], key: str, order: list[str] | None = None, within: list[str] | None = None) -> DataFrame:
    """Landed query results (`results.bindings` of name -> value) as rows: missing is '', rows without key go, first of each key stays.

    `order` are columns of results that put answers in order, `within` those that a key is unique in.
    """
    order, within = order or [], within or []
    b = results.select(*dict.fromkeys([*within, *order]), F.posexplode("results.bindings").alias("pos", "b"))
    rows = b.select(*dict.fromkeys([*within, *order]), "pos", *[F.coalesce(F.col(f"b.{n}.value"), F.lit("")).alias(n) for n in names]).where(F.col(key) != "")
    return keep_first(rows, [*within, key], [*order, "pos"]).select(*within, *names)


def paged_bindings(spark: SparkSession, folder: str, names: list[str], key: str, limit: int = 5000, most_pages: int = 5, block: int | None = None) -> DataFrame:
    """(year, names): a scan of answers that landed as JSON below year=.../page=..., a page's number counting from 0. With `block`, answers hold their page and
    landed below year=.../block=..., the page by `block` rounded down, so that there are fewer folders than pages.

    Each year ends at its first page of fewer than `limit` bindings, before the first that is missing, or after `most_pages`; what landed behind that is not
    read as data. Of each key of a year the first row stays. Filters on year prune folders; a task reads whole pages and holds one at a time.
    """
    landed = spark.read.schema(bindings_schema(names) + ", year int, page int").json(folder).where(F.col("page") < most_pages)
    if block:
        landed = landed.where(F.col("block") <= (most_pages - 1) // block)
    sizes = landed.groupBy("year", "page").agg(F.sum(F.coalesce(F.size("results.bindings"), F.lit(0))).alias("n"))  # a row a page
    by_page = Window.partitionBy("year").orderBy("page")
    short = F.coalesce(F.sum((F.col("n") < limit).cast("int")).over(by_page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    read = sizes.withColumn("gap", F.row_number().over(by_page) - 1 != F.col("page")).withColumn("short", short).where("not gap and short = 0").select("year", "page")
    return decode_bindings(landed.join(read, ["year", "page"], "left_semi"), names, key, order=["page"], within=["year"])


def bindings_schema(names: list[str]) -> str:
    inner = ", ".join(f"{n}: struct<{BINDING}>" for n in names)
    return f"results struct<bindings: array<struct<{inner}>>>"


def sitemap_rows(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """(url, lastmod) of the pages of sitemaps held as text, in order; entries without a location go. Sitemaps that one lists are for `sitemap_tree`."""
    entries = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))
    d = pages.select(F.posexplode(entries).alias("pos", "e"))
    url = F.trim(F.regexp_extract("e", r"(?s)<loc>\s*(.*?)\s*</loc>", 1))
    return d.select("pos", url.alias("url"), F.trim(F.regexp_extract("e", r"(?s)<lastmod>\s*(.*?)\s*</lastmod>", 1)).alias("lastmod")).where("url <> ''")


def sitemap_tree(landed: DataFrame, root: str, new_folder: Callable[[], str], depth: int = 2, children: int = 30, key: str = "map", xml: str = "xml") -> DataFrame:
    """(url, lastmod, depth) of the pages that a landed sitemap and those it lists name, level by level.

    Only the first `children` sitemaps of each one are followed, `depth` levels deep, each sitemap once, at its least depth; one that has not landed has no
    pages. Entries without a location go. `new_folder()` names a new shared folder.
    """
    entry = lambda tag: F.regexp_extract_all(F.col(xml), F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    place = lambda e: F.trim(F.regexp_extract(e, r"(?s)<loc>\s*(.*?)\s*</loc>", 1))
    maps = F.filter(F.transform(entry("sitemap"), place), lambda u: u != "")
    links = landed.select(F.col(key).alias("src"), F.posexplode(maps).alias("pos", "dst"))
    seeds = landed.where(F.col(key) == root).select(F.col(key).alias("page"))
    reached = crawl(links, seeds, new_folder, depth=depth, fan_out=children).withColumnRenamed("page", key)
    rows = landed.join(reached, key).select("depth", F.explode(entry("url")).alias("_e"))
    return rows.select(place(F.col("_e")).alias("url"), F.trim(F.regexp_extract("_e", r"(?s)<lastmod>\s*(.*?)\s*</lastmod>", 1)).alias("lastmod"), "depth").where("url <> ''")


def binary_rows(spark: SparkSession, path: str, glob: str, least: int = 100, most: int = 50 << 20, magic: bytes | None = b"%PDF-") -> DataFrame:
    """(path, length, sha256, content) of files within the size bounds that begin with the magic bytes."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).where(F.col("length").between(least + 1, most))
    if magic:
        raw = raw.where(F.substring(F.hex("content"), 1, 2 * len(magic)) == magic.hex().upper())
    return raw.select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def fetch_outcome(status, body_length, least: int = 50):
    """Outcome of a landed fetch: success, missing, retry or failed."""
    return F.when((status == 200) & (body_length > least), "success").when(status.isin(404, 410, 403), "missing").when((status == 429) | (status >= 500), "retry").otherwise("failed")
