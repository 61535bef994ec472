"""The corpus pipeline over `documents`: toxicity, near-duplicates, decontamination, mixing, sharding.

Every stage takes the rows that the one before kept and returns the columns of documents; the last adds virtual_slot and
shard. SQL cannot state the trained, sketched and aligned stages, so the pipeline is tested against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, mixing, neardup, sharding, toxicity
from corpusloom.llm.common import drop_table, fresh, materialize, quoted, table, text_or_empty


def keep_ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the compression classifier, trained on this input's labelled rows, does not call toxic."""
    model = toxicity.train(*toxicity.sample(docs, table(spark, sf_dir, "labels")))
    score = fresh(docs, "toxicity")
    return toxicity.scored(docs, model, docs.columns, score).where(F.col(score) < 0.5).drop(score)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest doc_id of each class of near-duplicates."""
    return neardup.survivors(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item. Whether it does depends on the text alone, so texts are its keys."""
    key = fresh(docs, "text_key")
    keyed = docs.withColumn(key, F.md5(text_or_empty("text")))
    found = decontaminate.contaminated(keyed.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaks = materialize(found.select(F.col("doc_id").alias(key)).distinct(), "leaks")
    return keyed.join(leaks, key, "left_anti").select(*map(quoted, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as weighted fair queueing takes them."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.placed(docs)


STAGES = [
    ("toxicity", keep_ordinary),
    ("near-duplicates", keep_one_of_each),
    ("decontamination", keep_clean),
    ("mixing", mix_sources),
    ("sharding", shard),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = materialize(stage(spark, docs, sf_dir), name)
        if k:
            drop_table(docs)  # the next stages read what this one kept
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
