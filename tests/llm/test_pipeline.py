"""The pipeline's rows against the same decisions made by hand from the operators' own results."""

import corpus_pipeline
from pollwarden.llm import op01_decontaminate, op04_toxicity, op07_simhash


def test_pipeline_stage_by_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    model = op04_toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    left = {r.doc_id for r in op04_toxicity.with_toxicity(docs, ["doc_id"], model).collect() if r.tox_score < 0.7}
    text = {r.doc_id: r.text for r in docs.collect()}
    last = {}
    for i in left:
        key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text[i])
        last[key] = max(i, last.get(key, -1))
    left = set(last.values())
    rest = docs.where(docs.doc_id.isin(sorted(left)))
    left = {r.doc_id for r in op07_simhash.near_groups(rest).collect() if r.doc_id == r.component_id}
    rest = docs.where(docs.doc_id.isin(sorted(left)))
    left -= {r.doc_id for r in op01_decontaminate.contaminated(rest, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == left and len(got) == len(left)


def test_every_stage_takes_an_empty_table(spark, sf):
    empty = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
