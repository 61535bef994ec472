"""Text classification with MLlib: hashed words, inverse document frequency, weighted logistic regression."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .agreement import class_weights

MOST_TOKENS = 128


def first_tokens(text, most: int = MOST_TOKENS):
    """The text cut to its first tokens, as the model's input has it."""
    return F.array_join(F.slice(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), 1, most), " ")


def train(rows: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 16) -> PipelineModel:
    """Class-weighted classifier of (text, label) rows."""
    weights = class_weights(rows, label)
    data = rows.select(first_tokens(F.col(text)).alias("_text"), F.col(label).cast("string").alias("_label")).join(F.broadcast(weights.select(F.col("label").cast("string").alias("_label"), "weight")), "_label")
    stages = [
        StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol="_text", outputCol="_tokens", pattern=r"\W+"),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_x"),
        LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="weight", maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(data)


def predict(model: PipelineModel, rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with predicted and confidence."""
    labels = model.stages[0].labels
    tail = PipelineModel(model.stages[1:])
    out = tail.transform(rows.withColumn("_text", first_tokens(F.col(text))))
    p = vector_to_array("probability")
    names = F.array(*[F.lit(x) for x in labels])
    return out.select(*rows.columns, F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"), F.round(F.array_max(p), 4).alias("confidence"))
