import corpus_pipeline
from pyspark.sql import functions as F

from tessera.llm import decontamination, near_join, quality
from tessera.llm.common import remainder, stored, table

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(table(SMALL, "documents"))
    before, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, SMALL), "t")
        if name != "token_ids":
            assert after.columns == docs.columns
            assert after.exceptAll(before).isEmpty()
        kept.append({r["doc_id"] for r in after.collect()})
        if name == "quality":
            scores = quality.scored(docs, spark.read.parquet(table(SMALL, "labels")), remainder(F.col("doc_id"), 5) == 0)
            assert kept[-1] == {r["doc_id"] for r in scores.where("predicted = 1").collect()}
        if name == "near_duplicates":
            found = near_join.near_duplicates(before)
            assert kept[-1] == {r["doc_id"] for r in found.where("component_id = doc_id or n_shingles = 0").collect()}
        if name == "decontamination":
            found = decontamination.contained_items(before, spark.read.parquet(table(SMALL, "benchmark")))
            assert kept[-1] == kept[-2] - {r["doc_id"] for r in found.collect()}
        before = after
    assert kept[-1] == kept[-2]
    assert all(a >= b for a, b in zip(kept, kept[1:], strict=False))
