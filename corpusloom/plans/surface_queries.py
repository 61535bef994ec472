"""Queries in SQL over the extension surface, and of the training loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import surface, wordpiece
from ..operators import training
from .registry import query, table
from .shared import shared_folder


@query("sql_page_links", """SELECT page_id, unnest(k) AS link, (generate_subscripts(k, 1) - 1)::INT AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS k FROM pages)""")
def sql_page_links(spark, sf):
    """A table function joined laterally."""
    surface.register(spark)
    return spark.sql("SELECT page_id, l.link, l.pos FROM {pages}, LATERAL page_links(html) l", pages=table(spark, sf, "pages"))


@query("sql_text_chunks")
def sql_text_chunks(spark, sf):
    """A table function over partitions of a table."""
    surface.register(spark)
    docs = table(spark, sf, "documents").where("doc_id is not null").select("doc_id", "text")
    docs.createOrReplaceTempView("corpusloom_chunk_input")
    return spark.sql("SELECT key AS doc_id, chunk_no, n_tokens, n_words, text FROM text_chunks(TABLE(corpusloom_chunk_input) PARTITION BY doc_id)")


GUESS = "CASE WHEN contains(lower(coalesce(text, '')), 'the') THEN 'en' WHEN contains(lower(coalesce(text, '')), 'der') THEN 'de' ELSE 'fr' END"
COUNTS = f"""g AS (SELECT source, coalesce(lang, '') AS lang, {GUESS} AS guess FROM documents),
c AS (SELECT source, label, sum(hit) AS hits, sum(guessed) AS guessed, sum(truth) AS truth FROM (
 SELECT source, lang AS label, 0 AS guessed, 1 AS truth, CASE WHEN lang = guess THEN 1 ELSE 0 END AS hit FROM g UNION ALL SELECT source, guess, 1, 0, 0 FROM g) GROUP BY source, label)"""


@query("sql_macro_f1", f"WITH {COUNTS} SELECT source, round(avg(CASE WHEN guessed + truth = 0 THEN 0 ELSE 2.0 * hits / (guessed + truth) END), 6)::DOUBLE AS macro_f1, round(max(2.0 * hits / (guessed + truth)), 6)::DOUBLE AS best_f1 FROM c GROUP BY source")
def sql_macro_f1(spark, sf):
    """A metric as an aggregate, over counts by label that SQL sums first."""
    surface.register(spark)
    table(spark, sf, "documents").createOrReplaceTempView("corpusloom_guess_input")
    counts = COUNTS.replace("FROM documents", "FROM corpusloom_guess_input")
    means = "m AS (SELECT source, macro_f1(hits, guessed, truth) AS f FROM c GROUP BY source), b AS (SELECT source, max(f1_of(hits, guessed, truth)) AS best FROM c GROUP BY source)"
    return spark.sql(f"WITH {counts}, {means} SELECT m.source, round(f, 6) AS macro_f1, round(best, 6) AS best_f1 FROM m JOIN b ON m.source <=> b.source")


# Every letter and every pair of letters: a rule in place of a list. Words with anything else are one unknown piece.
LETTERS = [chr(k) for k in range(97, 123)]
PAIRS = LETTERS + [f"##{a}" for a in LETTERS] + [p + a + b for p in ("", "##") for a in LETTERS for b in LETTERS]


@query(
    "wordpiece_counts",
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS w FROM documents),
n AS (SELECT doc_id, sum(CASE WHEN length(w) <= 100 AND regexp_full_match(w, '[a-z]+') THEN (length(w) + 1) // 2 ELSE 1 END)::BIGINT AS n FROM w GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_tokens FROM documents LEFT JOIN n USING (doc_id)""",
)
def wordpiece_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", wordpiece.token_count(F.col("text"), PAIRS).alias("n_tokens"))


@query("train_early_stop")
def train_early_stop(spark, sf):
    """Macro-F1 of each epoch of a classifier of toxic labels, ended early; (epoch, macro_f1, best)."""
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    rows = table(spark, sf, "documents").join(labels, "doc_id").select("doc_id", "text", "label", F.when(F.col("doc_id") % 5 == 0, "held").otherwise("train").alias("split"))
    folder = shared_folder(spark, "training")
    run = training.fit(spark, folder, training.prepare(rows, folder, "doc_id", "split"), epochs=6, steps=2)
    return spark.createDataFrame([(e, round(f, 6), e == run.best) for e, f in run.history], "epoch int, macro_f1 double, best boolean")
