"""Web pages: the tree of elements against a slow version, malformed markup, time; dates and titles; mails."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import pagetree as P
from corpusloom.functions import text as T


def content(page, chrome=P.CHROME, containers=P.CONTAINERS):
    return P.content_of(page, P.Selectors(chrome), P.Selectors(containers), containers)


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("page", "text", "container", "removed"),
    [
        ("<body>a<nav>x<nav>y</nav>z</nav>b</body>", "a\nb", "body", 3),  # nested chrome goes whole
        ("<body>a<div class='x cookie-consent'>x<div>y</div>z</div>b</body>", "a\nb", "body", 3),
        ("<body><main>a<p>b<br>c</main>d</body>", "a\nb\nc", "main", 0),  # unclosed p ends with main; br never opens
        ("<main>a<nav>x</main>b", "a", "main", 1),  # unclosed chrome ends with what holds it
        ("<body><b><nav>x</b>y</nav>z</body>", "z", "body", 2),  # an end tag of no block closes no block
        ("<body>a</i>b</div>c", "abc", "body", 0),  # end tags that close nothing do not cut a text node
        ("<nav><main>x</main></nav><div id=main-content>a</div>", "a", "#main-content", 1),  # no container within chrome
        ("<div role='main'>a<div>b</div>c</div>d", "a\nb\nc", "[role=main]", 0),
        ("<body><script>if (a<b) '</p>'</script>a &amp; b&nbsp;</body>", "a & b", "body", len("if (a<b) '</p>'")),
        ("<BODY>A<!-- <nav> -->B<STYLE>x</STYLE></BODY>", "A\nB", "body", 1),
        ("no tags", "no tags", "", 0),
        ("<body>1 < 2 <p>a  \t b</p><!-- open", "1 < 2\na b", "body", 0),
        (None, "", "", 0),
        ("", "", "", 0),
    ],
)
def test_page_tree(page, text, container, removed):
    assert content(page) == (text, container, removed)


def slow(page):
    """Text of the body outside nav and the container, from nested lists: elements are found by counting tags of their name."""
    tokens = re.findall(r"<[^<>]*>|[^<]+", page)
    name = lambda t: t.strip("</>") if t.startswith("<") else ""

    def end(i):
        depth = 0
        for j in range(i, len(tokens)):
            if name(tokens[j]) == name(tokens[i]):
                depth += -1 if tokens[j].startswith("</") else 1
                if not depth:
                    return j
        return len(tokens)

    opens = [i for i, t in enumerate(tokens) if t.startswith("<") and not t.startswith("</")]
    out = {k for i in opens if name(tokens[i]) == "nav" for k in range(i, end(i))}
    boxes = [(("main", "body").index(name(tokens[i])), i) for i in opens if name(tokens[i]) in ("main", "body") and i not in out]
    kept = lambda a, b: "\n".join(re.sub("  +", " ", t.strip()) for k, t in enumerate(tokens[a:b], a) if not t.startswith("<") and k not in out and t.strip())
    removed = sum(len(t) for k, t in enumerate(tokens) if k in out and not t.startswith("<"))
    if not boxes:
        return kept(0, len(tokens)), "", removed
    rank, i = min(boxes)
    return kept(i, end(i)), ("main", "body")[rank], removed


def test_page_tree_against_slow_version():
    rnd = random.Random(2)

    def tree(depth):
        parts = []
        for _ in range(rnd.randrange(4)):
            tag = rnd.choice(["div", "nav", "main", "p", "section"])
            parts.append(rnd.choice(["a", " bc ", "d e"]) if depth == 0 or rnd.random() < 0.4 else f"<{tag}>{tree(depth - 1)}</{tag}>")
        return "".join(parts)

    for _ in range(400):
        page = f"<body>{tree(5)}</body>" if rnd.random() < 0.7 else tree(5)
        assert content(page, ("nav",), ("main", "body")) == slow(page)


@pytest.mark.parametrize("unit", ["<b>", "</b>", "<p>x", "<", "<a ", "<!-- ", "<nav>", "<div></p>", "<script>", "<b></i>", "a\n\n", "<a b='"])
def test_page_tree_is_linear(unit):
    took = []
    for n in (40_000, 160_000):
        start = time.process_time()
        content(unit * n)
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 0.2


def test_page_content_in_spark(spark):
    df = spark.createDataFrame([(1, "<body>a<nav>x</nav></body>", "t"), (2, None, "t")], "page_id int, html string, text string")
    rows = P.with_content(df).orderBy("page_id").collect()
    assert [(r["text"], r["container"], r["removed"]) for r in rows] == [("a", "body", 1), ("", "", 0)]


def test_page_date(spark):
    date = lambda html, url="u": one(spark, T.page_date(F.col("h"), F.col("u")), h=html, u=url)
    assert date("<p>Published 14.06.2021</p>") == "2021-06-14" == date("<p>on <b>14</b>.06.2021</p>", "2020-01-01")
    assert date("<script>01.01.2001</script><p title='02.02.2002'>none</p>", "a-2019-07-08") == "2019-07-08"
    assert date("<time datetime='x'>", "u") == ""


def test_site_names(spark):
    strip = lambda t: one(spark, T.drop_site(F.col("t")), t=t)
    assert strip("Trade policy - a short guide") == "Trade policy - a short guide"
    assert strip("Trade policy - a guide | European Commission") == "Trade policy - a guide" and strip("Steel -EU news") == "Steel"


def test_mails_in_linear_time(spark):
    drop = lambda t: one(spark, T.drop_emails(F.col("t")), t=t)
    for t in ["a b@c.de f", "@x.y", "a@@b.c", "a@b", "a@.b", "a@b.", "x a@b..", "(a@b.c),d@e.f g", "a@b c.d", "é@ü.ö"]:
        assert drop(t) == re.sub(r"\S+@\S+\.\S+", " ", t), t
    start = time.perf_counter()
    assert drop("a@" * 500_000) == "a@" * 500_000 and drop("x" * 1_000_000 + "@y") and drop("a." * 500_000)
    assert time.perf_counter() - start < 10


def test_reference_cut_short_stays():
    assert content("<body><p>a &amp; b&amp</p><p>&lt;x&gt; &#65;&#x42; &ampfoo; &copy</p></body>")[0] == "a & b&amp\n<x> AB &ampfoo; &copy"


def test_clean_works_each_step_out_once(spark):
    df = spark.createDataFrame([("a",)], "t string").select(T.clean(F.col("t")).alias("x"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("https?") == 1
    words = lambda n: " \n".join(["ab"] * n) + " "
    rows = spark.createDataFrame([(t,) for t in [words(14), words(15), "", None, words(14) + "c@d.e"]], "t string").select(T.clean(F.col("t")).alias("x"), T.word_count(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == [14, 15, 0, 0, 15] and [r["x"] is None for r in rows] == [True, False, True, True, True]
    lines = spark.createDataFrame([(x,) for x in ["12 ab 34", "12 abc 34", "a-b-c-", "a-b---", "1-2", "  1-2  ", "éàüöïß", "a1b2c3"]], "t string").select(T.numeric_row(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in lines] == [True, False, False, True, False, False, True, False]
