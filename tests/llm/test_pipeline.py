"""The pipeline: each stage against a brute-force version of its decision."""

import corpus_pipeline
from corpusloom.llm import decontaminate, neardup
from corpusloom.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "t")
        kept[name] = docs.collect()
        if name != "sharding":
            assert docs.columns == columns
    hasher = neardup.Hasher()
    bags = [hasher.bag(r["text"]) for r in kept["near-duplicates"]]
    before = {r["doc_id"] for r in kept["toxicity"]}
    assert {r["doc_id"] for r in kept["near-duplicates"]} <= before
    assert not any(neardup.similarity(bags[i], bags[j]) >= 0.8 for i in range(len(bags)) for j in range(i))
    items = [" ".join(decontaminate.words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    flat = lambda r: " ".join(decontaminate.words(r["text"]))
    left = {r["doc_id"] for r in kept["decontamination"]}
    for r in kept["near-duplicates"]:
        assert (r["doc_id"] in left) == (not any(i in flat(r) for i in items))
    assert {r["doc_id"] for r in kept["mixing"]} <= left
    assert len(kept["sharding"]) == len(kept["mixing"]) and {r["shard"] for r in kept["sharding"]} == set(range(8))


def test_clashing_columns_and_empty(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for c in ("score", "size", "shard", "node", "label", "text_key", "key"):
        docs = docs.withColumn(c, F.lit(1))
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "t")
    assert {"score", "size", "node", "label"} <= set(docs.columns)
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = materialize(stage(spark, none, SF), "t")
    assert none.count() == 0
