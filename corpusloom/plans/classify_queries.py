"""Queries of filters, lexicon classifiers and stance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import agreement, classifier, similarity, stance
from . import fixture as X
from .registry import query, table

LOW = "lower(coalesce(text, ''))"


def docs(spark, sf):
    return table(spark, sf, "documents").withColumn("low", F.lower(F.coalesce("text", F.lit(""))))


def has(term, text="low"):
    return f"contains({text}, '{term}')"


def n_has(terms, text="low"):
    return " + ".join(f"CASE WHEN {has(t, text)} THEN 1 ELSE 0 END" for t in terms)


def n_times(term, text="low"):
    return f"((length({text}) - length(replace({text}, '{term}', ''))) // {len(term)})"


def weighed(category):
    return " + ".join(f"{w} * {n_times(k)}" for c, w, k in X.ROWS if c == category)


SIMPLE = f"s AS (SELECT doc_id, source, lang, {weighed('tough')} AS tough, {weighed('cooperate')} AS coop FROM (SELECT *, {LOW} AS low FROM documents)), c AS (SELECT *, CASE WHEN tough - coop > 0.8 THEN 'tough' WHEN coop - tough > 0.8 THEN 'cooperate' ELSE 'neutral' END AS stance FROM s)"


def simple_stance(spark, sf):
    """Stance by weighted counts alone."""
    total = {c: sum((L.times(F.col("low"), k) * w for cat, w, k in X.ROWS if cat == c), F.lit(0.0)) for c in ("tough", "cooperate")}
    d = docs(spark, sf).select("doc_id", "source", "lang", total["tough"].alias("tough"), total["cooperate"].alias("coop"))
    return d.withColumn("stance", stance.classify(F.col("tough"), F.col("coop")))


@query(
    "stance_share_by_source",
    f"WITH {SIMPLE} SELECT source, count(*) AS n, round(100.0 * count(*) FILTER (stance = 'tough') / count(*), 4) AS tough, round(100.0 * count(*) FILTER (stance = 'cooperate') / count(*), 4) AS cooperate, round(100.0 * count(*) FILTER (stance = 'neutral') / count(*), 4) AS neutral FROM c GROUP BY source",
)
def stance_share_by_source(spark, sf):
    share = lambda s: F.round(F.count_if(F.col("stance") == s) * 100.0 / F.count(F.lit(1)), 4).alias(s)
    return simple_stance(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"), share("tough"), share("cooperate"), share("neutral"))


@query("stance_weighted_counts", f"WITH {SIMPLE} SELECT doc_id, tough::DOUBLE AS tough, coop::DOUBLE AS coop, stance FROM c")
def stance_weighted_counts(spark, sf):
    return simple_stance(spark, sf).select("doc_id", "tough", "coop", "stance")


@query("stance_cross_tab", f"WITH {SIMPLE} SELECT lang, count(*) FILTER (stance = 'cooperate') AS cooperate, count(*) FILTER (stance = 'neutral') AS neutral, count(*) FILTER (stance = 'tough') AS tough FROM c GROUP BY lang")
def stance_cross_tab(spark, sf):
    return simple_stance(spark, sf).groupBy("lang").pivot("stance", ["cooperate", "neutral", "tough"]).count().na.fill(0)


@query(
    "stance_year_shares",
    f"WITH {SIMPLE}, n AS (SELECT 2017 + doc_id % 10 AS year, stance, count(*) AS n FROM c GROUP BY ALL) SELECT year, stance, n, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY year), 2) AS share FROM n",
)
def stance_year_shares(spark, sf):
    """Stances of a year with their share of the year's rows; the window is over the counts."""
    n = simple_stance(spark, sf).groupBy((F.lit(2017) + F.col("doc_id") % 10).alias("year"), "stance").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("year")), 2))


@query("stance_neutral_side", f"WITH {SIMPLE} SELECT doc_id, source FROM c WHERE stance = 'neutral'")
def stance_neutral_side(spark, sf):
    return simple_stance(spark, sf).where("stance = 'neutral'").select("doc_id", "source")


@query("score_summary", f"WITH {SIMPLE} SELECT count(*) FILTER (tough > 0) AS n_tough, round(avg(tough) FILTER (tough > 0), 4) AS mean_tough, max(tough)::DOUBLE AS max_tough, count(*) FILTER (coop > 0) AS n_coop, round(avg(coop) FILTER (coop > 0), 4) AS mean_coop, max(coop)::DOUBLE AS max_coop FROM c")
def score_summary(spark, sf):
    out = []
    for c in ("tough", "coop"):
        out += [F.count_if(F.col(c) > 0).alias(f"n_{c}"), F.round(F.avg(F.when(F.col(c) > 0, F.col(c))), 4).alias(f"mean_{c}"), F.max(c).alias(f"max_{c}")]
    return simple_stance(spark, sf).agg(*out)


@query("stance_score")
def stance_score(spark, sf):
    """The full scorer: stems, overlaps, contrast, negation, modals."""
    return stance.score(docs(spark, sf).select("doc_id", "text"), X.LEXICON).select("doc_id", "tough_score", "cooperate_score", "stance")


@query("keyword_any_filter", f"SELECT doc_id FROM documents WHERE regexp_matches(lower(substr(regexp_replace(coalesce(text, ''), '[^ -~\\n]', '', 'g'), 1, 10000)), '\\bby\\b|with this|\\bare\\b')")
def keyword_any_filter(spark, sf):
    ascii_ = F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^ -~\n]", ""), 1, 10_000)
    return table(spark, sf, "documents").where(L.any_of(ascii_, ["by", "with this", "are"])).select("doc_id")


@query("exclusion_filter", "SELECT page_id FROM pages WHERE NOT regexp_matches(lower(url), '/(fr|de)/|ref=') AND (contains(lower(url), '/en/') OR contains(lower(url), 'example.com'))")
def exclusion_filter(spark, sf):
    u = F.lower(F.col("url"))
    return table(spark, sf, "pages").where(~u.rlike("/(fr|de)/|ref=") & (L.n_present(u, ["/en/", "example.com"]) > 0)).select("page_id")


POS = "instr(low, '{}') - 1"


@query(
    "dual_tier_filter",
    f"""WITH d AS (SELECT doc_id, {LOW} AS low FROM documents)
SELECT doc_id FROM d WHERE length(low) >= 150 AND ({n_has(X.TIER_ONE)} + {n_has(X.TIER_TWO)}) > 0
 AND (contains(substr(low, 1, 80), '{X.OVERLAY[0]}') OR {" + ".join(n_times(t) for t in X.OVERLAY)} >= 3 OR {" OR ".join(f"(instr(low, '{a}') > 0 AND instr(low, '{b}') > 0 AND abs(instr(low, '{a}') - instr(low, '{b}')) < 500)" for a in X.OVERLAY for b in X.TIER_TWO)})""",
)
def dual_tier_filter(spark, sf):
    low = F.col("low")
    tiers = L.n_present(low, X.TIER_ONE) + L.n_present(low, X.TIER_TWO) > 0
    at = lambda terms: F.filter(F.array(*[F.locate(t, low) for t in terms]), lambda p: p > 0)
    near = F.exists(at(X.OVERLAY), lambda p: F.exists(at(X.TIER_TWO), lambda q: F.abs(p - q) < 500))
    overlay = F.contains(F.substring(low, 1, 80), F.lit(X.OVERLAY[0])) | (L.total_times(low, X.OVERLAY) >= 3) | near
    return docs(spark, sf).where((F.length(low) >= 150) & tiers & overlay).select("doc_id")


@query(
    "white_black_filter",
    f"""WITH d AS (SELECT doc_id, {LOW} AS low FROM documents)
SELECT doc_id FROM d WHERE length(low) >= 200 AND ({n_has(X.PHRASES)}) >= 1 AND ({n_has(X.WHITE)}) >= 3 AND ({n_has(X.PHRASES, "substr(low, 1, 2500)")}) >= 1 AND ({n_has(X.BLACK)}) <= 3 * ({n_has(X.WHITE)})""",
)
def white_black_filter(spark, sf):
    low = F.col("low")
    white = L.n_present(low, X.WHITE)
    keep = (F.length(low) >= 200) & (L.n_present(low, X.PHRASES) >= 1) & (white >= 3) & (L.n_present(F.substring(low, 1, 2500), X.PHRASES) >= 1) & (L.n_present(low, X.BLACK) <= white * 3)
    return docs(spark, sf).where(keep).select("doc_id")


@query(
    "relevance_score",
    f"""WITH d AS (SELECT doc_id, {LOW} AS low FROM documents),
e AS (SELECT *, ({n_has(X.SUBJECT)}) > 0 AS subject, {n_has(X.TERMS)} AS n, ({" + ".join(n_times(t) for t in X.TERMS)})::DOUBLE / greatest(length(low), 1) AS density FROM d)
SELECT doc_id, round(CASE WHEN NOT subject THEN 0.0 WHEN n < 2 THEN 0.2 ELSE least(1.0, least(1.0, density * 100 + 0.3) + CASE WHEN n >= 4 THEN 0.2 ELSE 0 END) END, 4)::DOUBLE AS score, CASE WHEN NOT subject OR n < 2 THEN 'invalid' ELSE 'valid' END AS status FROM e""",
)
def relevance_score(spark, sf):
    low = F.col("low")
    subject, n = L.n_present(low, X.SUBJECT) > 0, L.n_present(low, X.TERMS)
    density = L.total_times(low, X.TERMS).cast("double") / F.greatest(F.length(low), F.lit(1))
    full = F.least(F.lit(1.0), F.least(F.lit(1.0), density * 100 + 0.3) + F.when(n >= 4, 0.2).otherwise(0.0))
    score = F.when(~subject, 0.0).when(n < 2, 0.2).otherwise(full)
    return docs(spark, sf).select("doc_id", F.round(score, 4).alias("score"), F.when(~subject | (n < 2), "invalid").otherwise("valid").alias("status"))


def first_sql(rules, default, text="low"):
    return "CASE " + " ".join(f"WHEN {' OR '.join(has(t, text) for t in terms)} THEN '{label}'" for label, terms in rules) + f" ELSE '{default}' END"


@query("classify_first_match", f"SELECT doc_id, {first_sql(X.TOPICS, 'other', 'substr(low, 1, 5000)')} AS topic, {first_sql(X.INSTITUTIONS, 'other', 'source')} AS institution FROM (SELECT *, {LOW} AS low FROM documents)")
def classify_first_match(spark, sf):
    return docs(spark, sf).select("doc_id", L.first_match(F.substring("low", 1, 5000), X.TOPICS, "other").alias("topic"), L.first_match(F.col("source"), X.INSTITUTIONS, "other").alias("institution"))


def best_sql(scores, least, default):
    pairs = ", ".join(f"{{'s': ({s})::DOUBLE, 'o': {-i}, 'l': '{label}'}}" for i, (label, s) in enumerate(scores))
    return f"CASE WHEN (list_sort([{pairs}], 'DESC')[1]).s >= {least} THEN (list_sort([{pairs}], 'DESC')[1]).l ELSE '{default}' END"


SCORED = [(label, " + ".join(f"(least({n_times(t)}, 5) + CASE WHEN {has(t, 'title')} THEN 2 ELSE 0 END) * {3 if t in X.STRONG else 1}" for t in terms)) for label, terms in X.TOPICS]
CAPPED = [(label, " + ".join(f"least({n_times(t, 'head')}, 10)" for t in terms)) for label, terms in X.TOPICS]


@query("classify_scored_topic", f"SELECT doc_id, {best_sql(SCORED, 5, 'other')} AS topic, {best_sql(CAPPED, 2, 'other')} AS capped_topic FROM (SELECT doc_id, {LOW} AS low, substr({LOW}, 1, 80) AS title, substr({LOW}, 1, 5000) AS head FROM documents)")
def classify_scored_topic(spark, sf):
    head = F.substring("low", 1, 5000)
    capped = L.best_label([(label, L.total_times(head, terms, 10)) for label, terms in X.TOPICS], 2, "other")
    return docs(spark, sf).select("doc_id", L.scored_topic(F.substring("low", 1, 80), F.col("low"), X.TOPICS, X.STRONG).alias("topic"), capped.alias("capped_topic"))


@query("classify_doc_type", f"SELECT page_id, CASE WHEN contains(url, 'page=') THEN 'listing' ELSE {first_sql(X.KINDS, 'other', 'url')} END AS doc_type FROM pages")
def classify_doc_type(spark, sf):
    clue = F.when(F.contains("url", F.lit("page=")), "listing").otherwise(L.first_match(F.col("url"), X.KINDS, "other"))
    return table(spark, sf, "pages").select("page_id", clue.alias("doc_type"))


@query(
    "institution_by_segment",
    """WITH c AS (SELECT page_id, unnest([regexp_extract(url, '([^/]*)/*$', 1), regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)]) AS c FROM pages),
r AS (SELECT * FROM (VALUES ('listing', 'page=', 1), ('early', '3', 2), ('early', '5', 2), ('tagged', 'ref=', 3), ('tagged', 'utm_', 3), ('tenth', '10', 4), ('titled', 'the', 5), ('titled', 'und', 5)) r(label, term, place)),
m AS (SELECT page_id, min_by(label, place) AS label FROM c JOIN r ON contains(lower(c), term) GROUP BY page_id)
SELECT page_id, coalesce(label, 'other') AS institution FROM pages LEFT JOIN m USING (page_id)""",
)
def institution_by_segment(spark, sf):
    """By priority over the last segment of the address and the title of each page."""
    candidates = F.array(L.last_segment(F.col("url")), F.regexp_extract("html", "(?s)<title[^>]*>(.*?)</title>", 1))
    return table(spark, sf, "pages").select("page_id", L.by_priority(candidates, X.SEGMENTS, "other").alias("institution"))


@query(
    "doc_type_most_terms",
    f"""WITH h AS (SELECT doc_id, substr({LOW}, 1, 800) AS low FROM documents), n AS (SELECT doc_id, {', '.join(f"{n_has(terms)} AS {label}" for label, terms in X.TOPICS)} FROM h)
SELECT doc_id, CASE greatest({', '.join(label for label, _ in X.TOPICS)}) WHEN 0 THEN 'other' {' '.join(f"WHEN {label} THEN '{label}'" for label, _ in X.TOPICS)} END AS doc_type FROM n""",
)
def doc_type_most_terms(spark, sf):
    """The kind most of whose terms the first 800 characters hold."""
    return docs(spark, sf).select("doc_id", L.most_terms(F.substring("low", 1, 800), X.TOPICS, "other").alias("doc_type"))


EVIDENCE = (
    f"ev AS (SELECT k.keyword, k.category, k.weight, count(d.doc_id) AS total, count(*) FILTER (d.label = k.category) AS correct FROM (VALUES {', '.join(f"('{c}', {w}::DOUBLE, '{k}')" for c, w, k in X.ROWS)}) k(category, weight, keyword)"
    f" LEFT JOIN (SELECT d.doc_id, {LOW} AS low, CASE WHEN l.quality = 1 THEN 'cooperate' ELSE 'tough' END AS label FROM documents d JOIN labels l USING (doc_id)) d ON contains(d.low, k.keyword) GROUP BY ALL),"
    " p AS (SELECT *, CASE WHEN total = 0 THEN 0 ELSE correct::DOUBLE / total END AS precision FROM ev)"
)


def evidence(spark, sf):
    labelled = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn("label", F.when(F.col("quality") == 1, "cooperate").otherwise("tough"))
    return agreement.keyword_evidence(labelled, X.ROWS, "label")


@query("keyword_precision", f"WITH {EVIDENCE} SELECT keyword, category, weight, total, correct, round(precision, 4) AS precision FROM p")
def keyword_precision(spark, sf):
    return evidence(spark, sf).withColumn("precision", F.round("precision", 4))


@query("precision_summary", f"WITH {EVIDENCE} SELECT category, round(avg(precision), 4) AS mean, round(median(precision), 4) AS median, round(min(precision), 4) AS low, round(max(precision), 4) AS high FROM p GROUP BY category")
def precision_summary(spark, sf):
    r = lambda c, n: F.round(c, 4).alias(n)
    return evidence(spark, sf).groupBy("category").agg(r(F.avg("precision"), "mean"), r(F.median("precision"), "median"), r(F.min("precision"), "low"), r(F.max("precision"), "high"))


TIERS = "t AS (SELECT category, weight, CASE WHEN count(*) FILTER (total >= 3) = 0 THEN 1.0 ELSE greatest(0.3, least(1.5, 0.5 + avg(precision) FILTER (total >= 3))) END AS factor FROM p GROUP BY ALL)"


@query("tier_adjustment", f"WITH {EVIDENCE}, {TIERS} SELECT category, weight, round(factor, 4)::DOUBLE AS factor FROM t")
def tier_adjustment(spark, sf):
    return agreement.tier_factors(evidence(spark, sf)).withColumn("factor", F.round("factor", 4))


@query(
    "reweight",
    f"WITH {EVIDENCE}, {TIERS}, w AS (SELECT keyword, category, weight, round_even(weight * CASE WHEN total >= 3 THEN greatest(0.3, least(1.5, 0.5 + precision)) ELSE factor END, 2) AS raw FROM p JOIN t USING (category, weight)) SELECT keyword, category, weight, greatest(0.5, least(3.0, round_even(raw * 2, 0) / 2))::DOUBLE AS new_weight FROM w",
)
def reweight(spark, sf):
    return agreement.reweighted(evidence(spark, sf))


@query("confusion_matrix", "SELECT t.v AS truth, g.v AS guess, count(l.doc_id) AS n FROM (VALUES (0), (1)) t(v) CROSS JOIN (VALUES (0), (1)) g(v) LEFT JOIN labels l ON l.quality = t.v AND l.toxic = g.v GROUP BY ALL")
def confusion_matrix(spark, sf):
    return agreement.confusion(table(spark, sf, "labels"), "quality", "toxic", [0, 1])


PRF = """c AS (SELECT v AS label, count(*) FILTER (quality = v) AS support, count(*) FILTER (toxic = v) AS guessed, count(*) FILTER (quality = v AND toxic = v) AS hit FROM labels, (VALUES (0), (1)) x(v) GROUP BY v),
pr AS (SELECT label, support, CASE WHEN guessed = 0 THEN 0 ELSE hit::DOUBLE / guessed END AS p, CASE WHEN support = 0 THEN 0 ELSE hit::DOUBLE / support END AS r FROM c),
f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM pr)"""


@query("prf_per_class", f"WITH {PRF} SELECT label, round(p, 4) AS precision, round(r, 4) AS recall, round(f1, 4) AS f1, support FROM f")
def prf_per_class(spark, sf):
    d = agreement.per_class(table(spark, sf, "labels"), "quality", "toxic", [0, 1])
    return d.select("label", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("macro_f1", f"WITH {PRF} SELECT round(avg(f1), 4) AS macro_f1, round((SELECT avg((quality = toxic)::INT::DOUBLE) * 100 FROM labels), 2) AS agreement FROM f")
def macro_f1(spark, sf):
    labels = table(spark, sf, "labels")
    macro = agreement.per_class(labels, "quality", "toxic", [0, 1]).agg(F.round(F.avg("f1"), 4).alias("macro_f1"))
    return macro.join(labels.agg(F.round(F.avg((F.col("quality") == F.col("toxic")).cast("double")) * 100, 2).alias("agreement")))


@query(
    "kappa",
    """WITH n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (quality = toxic) / count(*)::DOUBLE AS po FROM labels),
e AS (SELECT sum(a.n::DOUBLE * b.n) AS cross_n FROM (SELECT quality AS v, count(*) AS n FROM labels GROUP BY 1) a JOIN (SELECT toxic AS v, count(*) AS n FROM labels GROUP BY 1) b USING (v)),
k AS (SELECT n::BIGINT AS n, po, cross_n / (n * n) AS pe FROM n, e)
SELECT n, round(po, 4) AS observed, round(pe, 4) AS expected, round((po - pe) / (1 - pe), 4) AS kappa, CASE WHEN (po - pe) / (1 - pe) >= 0.8 THEN 'excellent' WHEN (po - pe) / (1 - pe) >= 0.75 THEN 'good' WHEN (po - pe) / (1 - pe) >= 0.6 THEN 'fair' ELSE 'poor' END AS grade FROM k""",
)
def kappa(spark, sf):
    d = agreement.kappa(table(spark, sf, "labels"), "quality", "toxic")
    return d.select("n", *[F.round(c, 4).alias(c) for c in ("observed", "expected", "kappa")], "grade")


@query("conflict_types", "SELECT quality::VARCHAR || '->' || toxic::VARCHAR AS conflict_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share FROM labels WHERE quality <> toxic GROUP BY 1")
def conflict_types(spark, sf):
    n = table(spark, sf, "labels").where("quality <> toxic").groupBy(F.concat_ws("->", F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("conflict_type")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("all")))).select("conflict_type", "n", F.round(F.col("n") * 100.0 / F.col("all"), 4).alias("share"))


@query("class_weights", "WITH n AS (SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1) SELECT label, n, round((SELECT sum(n) FROM n)::DOUBLE / ((SELECT count(*) FROM n) * n), 6) AS weight FROM n")
def class_weights(spark, sf):
    return agreement.class_weights(table(spark, sf, "orders"), "o_orderstatus").withColumn("weight", F.round("weight", 6))


@query("vocabulary_repair", "WITH v AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN ' Tuogh ' WHEN doc_id % 4 = 1 THEN 'COOPERATE' WHEN doc_id % 4 = 2 THEN 'nuetral' ELSE 'tough' END AS v FROM documents) SELECT CASE lower(trim(v)) WHEN 'tuogh' THEN 'tough' WHEN 'nuetral' THEN 'neutral' ELSE lower(trim(v)) END AS label, count(*) AS n FROM v GROUP BY 1")
def vocabulary_repair(spark, sf):
    k = F.col("doc_id") % 4
    v = F.when(k == 0, " Tuogh ").when(k == 1, "COOPERATE").when(k == 2, "nuetral").otherwise("tough")
    repairs = F.create_map(*[F.lit(x) for x in ("tuogh", "tough", "nuetral", "neutral")])
    clean = F.lower(F.trim(v))
    return table(spark, sf, "documents").groupBy(F.coalesce(F.try_element_at(repairs, clean), clean).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("similarity_flag")
def similarity_flag(spark, sf):
    """Each document against the next one of its language by doc_id."""
    return similarity.compare(next_of_language(table(spark, sf, "documents")), "a", "b").select("doc_id", "similarity", "abnormal")


def next_of_language(documents, block=1000):
    """(doc_id, a, b): the text of each document and of the next one of its language by doc_id; none for the last of a language.

    Neighbours are found in blocks of ids; the last row of a block meets the first row of the next block that has rows, found over
    one row a block and language."""
    from pyspark.sql import Window

    d = documents.select("doc_id", "lang", F.col("text").alias("a"), F.floor(F.col("doc_id") / block).alias("block"))
    first = d.groupBy("lang", "block").agg(F.min(F.struct("doc_id", "a")).alias("head"))
    heads = first.withColumn("after", F.lead("head").over(Window.partitionBy("lang").orderBy("block"))).select(F.col("lang").alias("l"), F.col("block").alias("k"), "after")
    w = Window.partitionBy("lang", "block").orderBy("doc_id", "a")
    rows = d.withColumn("next", F.lead(F.struct("doc_id", "a")).over(w))
    pairs = rows.join(heads, F.col("lang").eqNullSafe(F.col("l")) & F.col("block").eqNullSafe(F.col("k")), "left")
    return pairs.withColumn("next", F.coalesce("next", "after")).where("next is not null").select("doc_id", "a", F.col("next.a").alias("b"))


@query("text_classifier")
def text_classifier(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "text", F.col("toxic").alias("label"))
    model = classifier.train(rows.where("doc_id % 5 <> 0"))
    return classifier.predict(model, rows.where("doc_id % 5 = 0").select("doc_id", "text")).select("doc_id", "predicted", "confidence")


