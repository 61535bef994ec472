"""Personal data: pattern spans, and terms that disclose them by corpus co-occurrence. DataFrame operations only.

Base spans come from fixed patterns (e-mail, IPv4, payment card with Luhn check, phone). The values found are the protected
entities. A term discloses an entity if meeting the term tells that the entity is near: with n(e), n(t) the documents
that hold entity and term, n(e,t) those that hold the term close to the entity, and N documents,

    disclosure(t, e) = log(n(e,t) * N / (n(e) * n(t))) / log(N / n(e)),

the share of the entity's information content that the term gives away (1: whoever has the term has the entity). Terms
at `generalise` or more are replaced by a broader form (the class of all words with the same first three letters, written `abc*`),
terms at `remove` or more are removed. A term counts only if it was met with the entity behind `support` different words to
the left and before `support` different words to the right, so copies of one document, edited ones too, prove nothing. All counts
run over all documents. Terms are whole words of three letters or more that no base span cuts or touches, counted within `width`
characters of the entity, not over whole documents, as in long documents every rarer word shares a document with an entity a
few times by chance and would be flagged. A flagged term is replaced or removed wherever it stands, far from the entity and in
documents that do not hold it too, since it gives the entity away there.

Plan: one pass finds spans and contexts (only rows that hold a digit or `@` are searched); entity contexts are exploded and
counted with map-side partial aggregation; n(t) is counted for candidate terms only (those not too common in the documents that
hold entities already), in a second pass over all texts, whose words are counted in each task before they are shuffled and
joined to the candidates. A third pass over all texts finds those that hold flagged terms, and their places. Added spans depend on the text alone, so
they are kept once a distinct text and joined back by its hash; a small side of these joins is broadcast under the same bound.

Patterns use possessive quantifiers and look-behinds that leave their matches as they are but keep them linear in
the text's length and off the regex engine's stack. Contexts are cut from a copy of the text in which base spans are blotted
out, so a context costs no look at the other spans.

Edge cases: a null text is empty (no spans); repeated rows each give a row and count as documents; very long texts and texts of
thousands of spans are searched whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_or_empty

LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Only maximal digit runs of 16 to 19 digits match.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
CONTEXT, SUPPORT, GENERALISE, REMOVE = 64, 3, 0.5, 0.8
BLOT = "\uffff"  # stands for each character of a base span; in no text, being no character
BROADCAST_TERMS = 100_000
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    d = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when(((n - i) % 2) == 1, F.when(F.substring(digits, i, F.lit(1)).cast("int") * 2 > 9, F.substring(digits, i, F.lit(1)).cast("int") * 2 - 9).otherwise(F.substring(digits, i, F.lit(1)).cast("int") * 2)).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?(?:\.|$)){4}$")
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def running(items: Column, kind: str, step) -> Column:
    """All results of step(at, item) -> (next at, result of type kind), from at = 0 on.

    The fold goes over chunks of about sqrt(n) items, since an array that grows by one element is copied each time.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc, x):
        at, out = step(acc["at"], x)
        return F.struct(at.alias("at"), F.array_append(acc["out"], out).alias("out"))

    def chunk(acc, part):
        own = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), one)
        return F.struct(own["at"].alias("at"), F.array_append(acc["out"], own["out"]).alias("out"))

    size = F.greatest(F.ceil(F.sqrt(F.size(items))), F.lit(1)).cast("int")
    held = F.array(F.struct(items.alias("of"), size.alias("size")))  # so that items are found once
    parts = F.transform(held, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x["of"]), F.lit(1)), x["size"]), lambda i: F.slice(x["of"], i, x["size"])))[0]
    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out")), chunk, lambda acc: F.flatten(acc["out"]))


def matches(text: Column, pattern: str | Column, kind: str) -> Column:
    """array of (kind, start, end, value) of all matches: the texts between matches give the places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def step(at, x):
        a = at + F.length(x["g"])
        b = a + F.length(x["h"])
        return b, F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"), x["h"].alias("value"))

    zipped = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("h"), g.alias("g")))
    found = running(zipped, SPAN[6:-1], step)
    return F.when(F.size(hits) > 0, F.filter(found, lambda s: valid(kind, s["value"]))).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """All base spans by kind as listed, then start."""
    none = F.array().cast(SPAN)
    may = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]{2}|[0-9][ -][0-9]"), "phone": text.rlike(r"\+[0-9]")}
    return F.concat(*[F.when(may[k], matches(text, p, k)).otherwise(none) for k, p in PATTERNS.items()])


def entity(kind: Column, value: Column) -> Column:
    """Spellings of one number are one entity."""
    return F.concat(kind, F.lit(":"), F.when(kind == "email", F.lower(value)).when(kind == "ip", value).otherwise(F.regexp_replace(value, "[^0-9]", "")))


def blocks(text: Column) -> Column:
    """The text in blocks of CONTEXT characters: a place is found in its block, not by counting from the text's first byte."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CONTEXT}}}"), F.lit(0))


def piece(cut: Column, start: Column, size: Column) -> Column:
    """The characters [start, start + size) of a text in blocks, as far as there are any."""
    first = F.floor(start / CONTEXT).cast("int")
    some = F.slice(cut, first + 1, F.floor((start + size) / CONTEXT).cast("int") - first + 1)
    return F.substring(F.array_join(some, ""), start - first * CONTEXT + 1, size)


def blotted(cut: Column, spans: Column, length: Column) -> Column:
    """The text, given in blocks, with BLOT for each character of a span."""
    ends = F.struct(length.alias("start"), length.alias("end"))
    in_order = F.array_sort(F.concat(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))), F.array(ends)))

    def step(at, s):
        gap = piece(cut, at, F.greatest(s["start"] - at, F.lit(0)))
        return F.greatest(at, s["end"]), F.concat(gap, F.repeat(F.lit(BLOT), s["end"] - F.greatest(at, s["start"])))

    return F.array_join(running(in_order, "string", step), "")


def near_terms(cut: Column, spans: Column, width: int) -> Column:
    """For each base span its entity, hashes of the words within `width` characters to either side, and these words. cut: the blotted text in blocks."""
    word = rf"(?<![\p{{L}}{BLOT}])\p{{L}}{{3,}}+(?!{BLOT})"

    def of(s):
        lo = F.greatest(s["start"] - width, F.lit(0))
        left = piece(cut, lo, s["start"] - lo)
        left_cut = F.when(lo > 0, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
        right = piece(cut, s["end"], F.lit(width))
        right_cut = F.when(F.length(right) == width, F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right)
        # What stands directly beside the span is cut by it.
        sides = [F.regexp_extract_all(F.concat(left_cut, F.lit(BLOT)), F.lit(word), F.lit(0)), F.regexp_extract_all(F.concat(F.lit(BLOT), right_cut), F.lit(word), F.lit(0))]
        left_words, right_words = (F.transform(x, lambda w: F.lower(w)) for x in sides)
        return F.struct(
            entity(s["kind"], s["value"]).alias("entity"),
            F.xxhash64(F.array_join(left_words, " ")).alias("left"),
            F.xxhash64(F.array_join(right_words, " ")).alias("right"),
            F.array_distinct(F.concat(left_words, right_words)).alias("terms"),
        )

    return F.transform(spans, of)


def find_base(docs: DataFrame, width: int = CONTEXT) -> DataFrame:
    """(doc_id, spans, near, own, text_key) of every row; near and own, the row's words, are null where it has no base span."""
    text = F.col("text")
    plain = docs.select("doc_id", text_or_empty("text").alias("text"))
    searched = F.when(text.contains("@") | text.rlike("[0-9]"), base_spans(text)).otherwise(F.array().cast(SPAN))
    some = F.size("spans") > 0
    rows = plain.withColumn("spans", searched).withColumn("cut", F.when(some, blocks(text)))
    rows = rows.withColumn("blank", F.when(some, blocks(blotted(F.col("cut"), F.col("spans"), F.length(text)))))
    near = F.when(some, near_terms(F.col("blank"), F.col("spans"), width))
    own = F.when(some, F.array_distinct(F.transform(words(text), lambda w: F.lower(w))))
    return rows.withColumn("near", near).select("doc_id", "spans", "near", own.alias("own"), F.md5("text").alias("text_key"))


def words(text: Column) -> Column:
    """All whole words of three letters or more."""
    return F.filter(F.split(text, r"\P{L}+"), lambda w: F.length(w) >= 3)


def disclosures(docs: DataFrame, base: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(entity, term, disclosure, action) of the terms that disclose an entity."""
    held = base.where("near is not null").select(F.monotonically_increasing_id().alias("row"), "near")
    per_doc = held.select(F.explode(F.array_distinct(F.col("near.entity"))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    met = held.select("row", F.explode("near").alias("n")).select("row", "n.entity", "n.left", "n.right", F.explode("n.terms").alias("term"))
    pairs = met.groupBy("entity", "term").agg(F.count_distinct("row").alias("n_et"), F.count_distinct("left").alias("lefts"), F.count_distinct("right").alias("rights"))
    seen = base.select(F.explode("own").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_own"))
    n = F.lit(float(max(base.count(), 1)))
    info = F.log(n / F.col("n_e"))

    def ratio(n_t: str) -> Column:
        return F.when(info > 0, F.round(F.log(F.col("n_et") * n / (F.col("n_e") * F.col(n_t))) / info, 9)).otherwise(F.lit(0.0))

    # A term is in as many documents as in those that hold entities at least, which leaves out the common words before all texts are searched.
    pairs = pairs.where(F.least("lefts", "rights") >= support).join(per_doc, "entity").join(seen, "term")
    pairs = materialize(pairs.where(ratio("n_own") >= generalise).drop("n_own"), "pairs")
    terms = materialize(pairs.select("term").distinct(), "terms")
    all_words = docs.select(F.explode(F.array_distinct(F.transform(words(text_or_empty("text")), lambda w: F.lower(w)))).alias("term"))
    # Words are counted before they meet the candidates: an inner join, since Spark moves a semi-join below the count.
    counts = all_words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(small(terms), "term")
    scored = pairs.join(counts, "term").select("entity", "term", ratio("n_t").alias("disclosure"))
    return scored.where(F.col("disclosure") >= generalise).withColumn("action", F.when(F.col("disclosure") >= remove, F.lit("remove")).otherwise(F.lit("generalise")))


def small(df: DataFrame) -> DataFrame:
    """A materialized table, broadcast in joins while it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


def everywhere(docs: DataFrame, flagged: DataFrame) -> DataFrame:
    """(text_key, start, end, action): all whole words of all texts that are flagged terms and not in a base span, once a distinct text."""
    text = F.col("text")
    keyed = docs.select(text_or_empty("text").alias("text")).withColumn("text_key", F.md5("text"))
    held = keyed.select("text_key", F.explode(F.array_distinct(words(text))).alias("word"))
    spelled = held.withColumn("term", F.lower("word")).join(small(flagged), "term").groupBy("text_key").agg(F.collect_set(F.struct("word", "action")).alias("put"))
    spelled = small(materialize(spelled, "spelled"))
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join("put.word", "|"), F.lit(r")(?!\p{L})"))
    action = lambda m: F.element_at(F.filter("put", lambda x: x["word"] == m["value"]), 1)["action"]
    # Of the base spans only addresses hold letters.
    spans = F.when(text.contains("@"), matches(text, PATTERNS["email"], "email")).otherwise(F.array().cast(SPAN))
    rows = keyed.join(spelled, "text_key").withColumn("spans", spans).withColumn("cut", blocks(text)).withColumn("blank", blocks(blotted(F.col("cut"), F.col("spans"), F.length(text))))
    clear = F.filter(matches(text, pattern, "term"), lambda m: ~piece(F.col("blank"), m["start"], m["end"] - m["start"]).contains(BLOT))
    places = F.transform(clear, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), action(m).alias("action")))
    return rows.select("text_key", F.explode(places).alias("p")).select("text_key", "p.*").distinct()


def find(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, spans, terms): base spans, and the added spans (start, end, action)."""
    base = materialize(find_base(docs), "pii")
    # A term that two entities flag is removed if either says so: "remove" sorts after "generalise".
    flagged = materialize(disclosures(docs, base, **limits).groupBy("term").agg(F.max("action").alias("action")), "flagged")
    added = everywhere(docs, flagged).groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "action"))).alias("terms"))
    added = small(materialize(added, "added"))
    none = F.array().cast("array<struct<start:int,end:int,action:string>>")
    return base.select("doc_id", "spans", "text_key").join(added, "text_key", "left").select("doc_id", "spans", F.coalesce("terms", none).alias("terms"))


def redact(text: Column, spans: Column, terms: Column) -> Column:
    """The sanitised text: base spans as [KIND], generalised terms as their first three letters and *, removed terms as nothing."""
    put = F.array_sort(
        F.concat(
            F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("to"))),
            F.transform(terms, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["action"] == "remove", F.lit("")).otherwise(F.concat(F.substring(text, t["start"] + 1, F.lit(3)), F.lit("*"))).alias("to"))),
        )
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["to"])
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), more.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    return F.aggregate(put, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def op9_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def digest(found: DataFrame) -> DataFrame:
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.array_join(F.transform("spans", label), ",")
    terms = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["end"].cast("string")))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in PATTERNS], F.sha2(base, 256).alias("base_sha256"), F.array_join(F.concat(F.transform("spans", label), terms), ",").alias("spans"), F.size("terms").alias("n_terms")
    )


SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
h AS (SELECT rid, o, kind, hits, gaps FROM (
        SELECT rid, 1 AS o, 'email' AS kind, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS hits, string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS gaps FROM d
        UNION ALL SELECT rid, 2, 'ip', regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), string_split_regex(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') FROM d
        UNION ALL SELECT rid, 3, 'card', regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), string_split_regex(text, '[0-9]([\x20-]?[0-9])+') FROM d
        UNION ALL SELECT rid, 4, 'phone', regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(text, '\+[0-9][\x20().0-9-]+[0-9]') FROM d) WHERE len(hits) > 0),
m AS (SELECT rid, o, kind, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS value, unnest(gaps[1:len(hits)]) AS gap FROM h),
q AS (SELECT rid, o, kind, value, regexp_replace(value, '[^0-9]', '', 'g') AS digits,
             (sum(length(gap) + length(value)) OVER (PARTITION BY rid, o ORDER BY i))::BIGINT AS e FROM m),
b AS MATERIALIZED (SELECT rid, o, kind, value, e - length(value) AS s, e, CASE WHEN kind = 'email' THEN 'email:' || lower(value) WHEN kind = 'ip' THEN 'ip:' || value ELSE kind || ':' || digits END AS entity FROM q
      WHERE CASE kind WHEN 'email' THEN true
                      WHEN 'ip' THEN len(list_filter(string_split(value, '.'), lambda x: coalesce(try_cast(x AS UBIGINT), 999) > 255)) = 0
                      WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15
                      ELSE length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
                           CASE WHEN (length(digits) - i) % 2 = 0 THEN digits[i]::INT WHEN digits[i]::INT > 4 THEN digits[i]::INT * 2 - 9 ELSE digits[i]::INT * 2 END)) % 10 = 0 END),
r AS (SELECT rid, regexp_extract_all(text, '\p{L}+') AS hits, string_split_regex(text, '\p{L}+') AS gaps, length(text) AS n FROM d),
w0 AS (SELECT rid, n, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS word, unnest(gaps[1:len(hits)]) AS gap FROM r WHERE len(hits) > 0),
w1 AS (SELECT rid, n, word, (sum(length(gap) + length(word)) OVER (PARTITION BY rid ORDER BY i))::BIGINT AS e FROM w0),
w AS MATERIALIZED (SELECT rid, n, lower(word) AS term, e - length(word) AS s, e FROM w1 WHERE length(word) >= 3),
whole AS MATERIALIZED (SELECT w.* FROM w SEMI JOIN b USING (rid) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.rid = w.rid AND b.s <= w.e AND w.s <= b.e)),
sides AS (SELECT b.rid, b.o, b.s, b.entity, x.term, x.s AS pos, x.s < b.s AS lefty FROM b JOIN whole x ON x.rid = b.rid
          AND ((x.e <= b.s AND (x.s > b.s - 64 OR b.s <= 64) AND x.s >= greatest(b.s - 64, 0)) OR (x.s >= b.e AND (x.e < b.e + 64 OR (x.n < b.e + 64 AND x.e <= x.n))))),
c AS (SELECT b.rid, b.o, b.s, b.entity, coalesce(string_agg(term, ' ' ORDER BY pos) FILTER (WHERE lefty), '') AS l, coalesce(string_agg(term, ' ' ORDER BY pos) FILTER (WHERE NOT lefty), '') AS r
      FROM b LEFT JOIN sides x ON x.rid = b.rid AND x.o = b.o AND x.s = b.s GROUP BY ALL),
p AS (SELECT x.entity, x.term, count(DISTINCT x.rid) AS n_et, least(count(DISTINCT l), count(DISTINCT r)) AS support
      FROM sides x JOIN c ON c.rid = x.rid AND c.o = x.o AND c.s = x.s GROUP BY x.entity, x.term HAVING least(count(DISTINCT l), count(DISTINCT r)) >= {support}),
ne AS (SELECT entity, count(DISTINCT rid) AS n_e FROM b GROUP BY entity),
nt AS (SELECT term, count(DISTINCT rid) AS n_t FROM w SEMI JOIN p USING (term) GROUP BY term),
f AS (SELECT DISTINCT term FROM p JOIN ne USING (entity) JOIN nt USING (term), (SELECT count(*)::DOUBLE AS n FROM d)
      WHERE n > n_e AND round(ln(n_et * n / (n_e * n_t)) / ln(n / n_e), 9) >= 0.5),
t AS (SELECT w.rid, w.s, w.e FROM w SEMI JOIN f USING (term) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.rid = w.rid AND b.s < w.e AND w.s < b.e)),
bs AS (SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS base, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip,
              count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone FROM b GROUP BY rid),
ts AS (SELECT rid, string_agg('term:' || s || ':' || e, ',' ORDER BY s) AS terms, count(*)::INT AS n_terms FROM t GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, concat_ws(',', base, terms) AS spans, coalesce(n_terms, 0)::INT AS n_terms
FROM d LEFT JOIN bs USING (rid) LEFT JOIN ts USING (rid)
"""
OP9_SQL = SQL.replace("{support}", str(SUPPORT))
