"""The SQL surface, WordPiece against a library, registered functions."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import surface, wordpiece
from corpusloom.operators import chunks
from corpusloom.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
PUBLIC = "/opt/tokenizers/word_bpe_49k.json"


def test_chunks_in_sql_equal_the_operator(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = ["doc_id", "chunk_no", "n_tokens", "n_words", "text"]
    want = sorted(tuple(r) for r in chunks.chunked(docs, ["doc_id"]).select(*columns).collect())
    assert sorted(tuple(r) for r in QUERIES["sql_text_chunks"](spark, SF).select(*columns).collect()) == want


def test_registered_functions(spark):
    def doubled(x: pd.Series) -> pd.Series:
        return x * 2

    surface.register(spark)
    surface.register_function(spark, "doubled", doubled, "long")
    assert [r[0] for r in spark.sql("SELECT doubled(id) FROM range(3) ORDER BY 1").collect()] == [0, 2, 4]
    assert spark.sql("SELECT f1_of(1, 2, 2), f1_of(0, 0, 0)").first()[:] == (0.5, 0.0)
    assert spark.sql("SELECT macro_f1(h, g, t) FROM VALUES (1L, 2L, 2L), (0L, 0L, 0L), (3L, 3L, 3L) x(h, g, t)").first()[0] == pytest.approx(0.5)
    assert [tuple(r) for r in spark.sql("""SELECT l.* FROM VALUES ('<a href="x">'), (NULL) p(html), LATERAL page_links(html) l""").collect()] == [(0, "x")]


def library(vocabulary):
    from tokenizers import Tokenizer, models

    return Tokenizer(models.WordPiece({p: k for k, p in enumerate([*dict.fromkeys([*vocabulary, wordpiece.UNKNOWN])])}, unk_token=wordpiece.UNKNOWN, max_input_chars_per_word=wordpiece.MOST_CHARS))


def test_wordpiece_against_library():
    rnd = random.Random(9)
    for _ in range(30):
        pieces = {"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 5))) for _ in range(rnd.randrange(1, 25))}
        vocabulary = sorted({rnd.choice(["", "##"]) + p for p in pieces} | {"##a"})
        ours, theirs = wordpiece.WordPiece(vocabulary), library(vocabulary)
        for _ in range(60):
            word = "".join(rnd.choice("abcé") if rnd.random() < 0.05 else rnd.choice("abc") for _ in range(rnd.choice([1, 3, 9, 101])))
            assert list(ours.pieces(word)) == theirs.encode(word, add_special_tokens=False).tokens


@pytest.mark.skipif(not os.path.exists(PUBLIC), reason="no public vocabulary here")
def test_public_vocabulary(spark):
    vocabulary = wordpiece.word_end_vocabulary(PUBLIC)
    theirs, rows = library(vocabulary), spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: (r["n"], r["first"]) for r in df.select("doc_id", wordpiece.token_count(F.col("text"), vocabulary).alias("n"), wordpiece.tokens(F.col("text"), vocabulary, 128).alias("first")).collect()}
    for r in rows:
        want = [t for w in wordpiece.WORD.findall((r["text"] or "").lower()) for t in theirs.encode(w, add_special_tokens=False).tokens]
        assert got[r["doc_id"]] == (len(want), want[:128])


def test_chunks_by_wordpiece(spark):
    vocabulary = ["word", "##s", "."]
    df = spark.createDataFrame([(1, "Words words words. " * 30)], "doc_id long, text string")
    out = chunks.chunked(df, ["doc_id"], budget=70, overlap=0, count=wordpiece.counter(vocabulary)).collect()
    assert [r["n_tokens"] for r in out] == [70, 70, 70] and wordpiece.WordPiece(vocabulary).tokens("Words, x") == ["word", "##s", "[UNK]", "[UNK]"]


def test_wordpiece_is_linear(spark):
    cut = wordpiece.WordPiece(["a", "##a"], most_chars=10**7)
    assert len(cut.cut("a" * 300_000)) == 300_000 and wordpiece.WordPiece([]).tokens("x y") == ["[UNK]", "[UNK]"]
