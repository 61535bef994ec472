"""The extension surface for SQL: table functions, and metrics as aggregates and functions, under names that `spark.sql` knows.

* `page_links(html)`: one row a link of a page, in order: pos, link.
* `text_chunks(TABLE(...) PARTITION BY key)`: chunk_no, n_tokens, n_words, text of rows (key, text); a partition is one key.
* `f1_of(hits, guessed, truth)`: F1 from three counts, 0 where nothing counts.
* `macro_f1(hits, guessed, truth)`: the mean F1 over rows of counts by label, which SQL has summed before.
* `register_function(spark, name, f, kind)`: any Python function of Arrow batches (pandas series in, pandas series out).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import BUDGET, LEAST_WORDS, OVERLAP, chunk_bounds, sentences, token_count

LINK = re.compile(r'href="([^"]+)"')


class PageLinks:
    def eval(self, html: str) -> Iterator[tuple]:
        for pos, m in enumerate(LINK.finditer(html or "")):
            yield pos, m[1]


class TextChunks:
    """Chunks of each row's text; rows of a partition come one after another, and their chunks are numbered through."""

    def __init__(self):
        self.key, self.no = None, 0

    def eval(self, row: Row) -> Iterator[tuple]:
        key, text = row[0], row["text"]
        if key != self.key:
            self.key, self.no = key, 0
        parts = sentences(text)
        tokens, words = [token_count(s) for s in parts], [len(s.split()) for s in parts]
        for a, b in chunk_bounds(tokens, BUDGET, OVERLAP):
            if sum(words[a:b]) >= LEAST_WORDS:
                yield key, self.no, sum(tokens[a:b]), sum(words[a:b]), " ".join(parts[a:b])
                self.no += 1


def register(spark: SparkSession) -> None:
    """Make the surface known to this session's SQL."""
    spark.udtf.register("page_links", F.udtf(PageLinks, returnType="pos int, link string"))
    spark.udtf.register("text_chunks", F.udtf(TextChunks, returnType="key long, chunk_no int, n_tokens int, n_words int, text string"))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION f1_of(hits BIGINT, guessed BIGINT, truth BIGINT) RETURNS DOUBLE RETURN CASE WHEN guessed + truth = 0 THEN 0D ELSE 2D * hits / (guessed + truth) END")

    register_function(spark, "macro_f1", mean_f1, "double")


def mean_f1(hits: pd.Series, guessed: pd.Series, truth: pd.Series) -> float:
    """Mean F1 over counts, one a label; a label that nothing counts for is 0."""
    both = guessed + truth
    return float((2 * hits / both.where(both > 0, 1)).mean()) if len(hits) else 0.0


def register_function(spark: SparkSession, name: str, f: Callable, kind: str) -> None:
    """A user's function of pandas series, with type hints, under a name for SQL: one that returns a series is a scalar function, one that returns a number an aggregate."""
    spark.udf.register(name, F.pandas_udf(f, kind))
