"""Agreement between two label columns, keyword evidence, and re-weighting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, guess: str, labels: list) -> DataFrame:
    """(truth, guess, n) for all pairs of labels, zeros included."""
    spark = df.sparkSession
    kind = df.schema[truth].dataType.simpleString()
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], f"truth {kind}, guess {kind}")
    n = df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(grid).join(n, ["truth", "guess"], "left").na.fill(0, ["n"])


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def per_class(df: DataFrame, truth: str, guess: str, labels: list) -> DataFrame:
    """(label, precision, recall, f1, support); a share of nothing is 0."""
    c = confusion(df, truth, guess, labels)
    by = c.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("guess").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    t = by.groupBy("label").agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit"))
    p, r = ratio(F.col("hit"), F.col("guessed")), ratio(F.col("hit"), F.col("support"))
    return t.select("label", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")


def kappa(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(n, observed, expected, kappa, grade) over all labels that either column has."""
    pairs = df.select(F.col(truth).cast("string").alias("a"), F.col(guess).cast("string").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = pairs.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), F.col("n")).otherwise(0)).alias("same"))
    rows = pairs.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("na"))
    cols = pairs.groupBy(F.col("b").alias("label")).agg(F.sum("n").alias("nb"))
    both = rows.join(cols, "label").agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("cross"))
    po, pe = F.col("same") / F.col("n"), F.coalesce("cross", F.lit(0.0)) / (F.col("n") * F.col("n"))
    out = total.join(F.broadcast(both)).select("n", po.alias("observed"), pe.alias("expected"), F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0).alias("kappa"))
    return out.withColumn("grade", grade(F.col("kappa")))


def grade(k: Column) -> Column:
    return F.when(k >= 0.8, "excellent").when(k >= 0.75, "good").when(k >= 0.6, "fair").otherwise("poor")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): n_all / (classes * n), the balanced weights."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return n.join(F.broadcast(total)).select(F.col(label).alias("label"), "n", (F.col("_all") / (F.col("_k") * F.col("n"))).alias("weight"))


def keyword_evidence(docs: DataFrame, lexicon: list[tuple[str, float, str]], label: str, text: str = "text") -> DataFrame:
    """(keyword, category, weight, total, correct, precision) of (category, weight, keyword) rows: a document counts once a keyword, correct if its label is the category."""
    hits = F.array_compact(F.array(*[F.when(F.contains(F.lower(F.col(text)), F.lit(k)), F.struct(F.lit(k).alias("keyword"), F.lit(c).alias("category"), F.lit(float(w)).alias("weight"))) for c, w, k in lexicon]))
    seen = docs.select(F.col(label).alias("label"), F.explode(hits).alias("h"))
    n = seen.groupBy("h.keyword", "h.category", "h.weight").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("label") == F.col("h.category")).alias("correct"))
    every = docs.sparkSession.createDataFrame([(k, c, float(w)) for c, w, k in lexicon], "keyword string, category string, weight double")
    out = F.broadcast(every).join(n, ["keyword", "category", "weight"], "left").na.fill(0, ["total", "correct"])
    return out.withColumn("precision", ratio(F.col("correct"), F.col("total")))


def tier_factors(evidence: DataFrame, least: int = 3) -> DataFrame:
    """(category, weight, factor): clamped mean precision of the tier's keywords with `least` hits; 1 without any."""
    some = evidence.where(F.col("total") >= least).groupBy("category", "weight").agg(F.avg("precision").alias("mean"))
    every = evidence.select("category", "weight").distinct()
    return every.join(some, ["category", "weight"], "left").select("category", "weight", F.when(F.col("mean").isNull(), 1.0).otherwise(F.greatest(F.lit(0.3), F.least(F.lit(1.5), 0.5 + F.col("mean")))).alias("factor"))


def reweighted(evidence: DataFrame, least: int = 3) -> DataFrame:
    """(keyword, category, weight, new_weight): own precision with `least` hits, else the tier's factor; to the half grid (half-even), within 0.5 and 3."""
    d = evidence.join(F.broadcast(tier_factors(evidence, least)), ["category", "weight"])
    own = F.greatest(F.lit(0.3), F.least(F.lit(1.5), 0.5 + F.col("precision")))
    raw = F.bround(F.col("weight") * F.when(F.col("total") >= least, own).otherwise(F.col("factor")), 2)
    return d.select("keyword", "category", "weight", F.greatest(F.lit(0.5), F.least(F.lit(3.0), F.bround(raw * 2, 0) / 2)).alias("new_weight"))
