"""The pipeline against its stages by brute force."""

from tests.llm.test_operators import SCHEMA, awkward_rows, components_by_brute_force, removed_by_brute_force

import corpus_pipeline
from tidemark.llm import packing, surrogates
from tidemark.llm.queries import surrogate_key, tokenizer_path


def test_stages(spark):
    rows = awkward_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "suffix_dedup", "pii_surrogates", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    first = stages["language_id"](spark, docs, "").collect()
    kept = {r.doc_id for r in first}
    assert all(r[0] in kept for r in rows if r[2]) and not any(r[0] in kept for r in rows if not any(c.isalpha() for c in r[1] or ""))

    second = stages["near_dedup"](spark, spark.createDataFrame(first, SCHEMA), "").collect()
    groups = components_by_brute_force([(r.doc_id, r.text) for r in first])
    assert sorted(r.doc_id for r in second if r.doc_id is not None) == sorted({c for _, c in groups.values()})

    third = stages["suffix_dedup"](spark, spark.createDataFrame(second, SCHEMA), "").collect()
    removed = removed_by_brute_force([(r.doc_id, r.text) for r in second])
    assert len(third) == len(second) and all(len(r.text.encode()) == removed[r.doc_id][0] - removed[r.doc_id][1] for r in third)
    assert all(r.n_chars == len(r.text) for r in third)

    fourth = stages["pii_surrogates"](spark, spark.createDataFrame(third, SCHEMA), "").collect()
    assert {r.doc_id: r.text for r in fourth} == {r.doc_id: surrogates.replaced(r.text, surrogate_key(spark))[0] for r in third}

    last = stages["packing"](spark, spark.createDataFrame(fourth, SCHEMA), "").collect()
    encoder = packing.encoder(tokenizer_path("word_bpe_49k.json"))
    assert sum(r.length for r in last) == sum(len(encoder.encode([r.text])[0]) + 1 for r in fourth)
    assert {r.doc_id for r in last} == {r.doc_id for r in fourth}


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
