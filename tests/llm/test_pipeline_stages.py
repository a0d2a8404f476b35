"""Stages of the pipeline on rows of their own."""

import corpus_pipeline
from spectrafold.llm import simhash


def test_duplicates_are_found_by_fingerprints_and_by_shingle_sets(spark):
    refrain = "x y z " * 50
    by_bits = [refrain + "p q r s t u v", refrain + "k l m n o"]
    assert simhash.simhash(by_bits[0], 3) == simhash.simhash(by_bits[1], 3)
    words = [f"w{k}" for k in range(200)]
    by_sets = [" ".join(words), " ".join(words[:190])]
    assert bin((simhash.simhash(by_sets[0], 3) ^ simhash.simhash(by_sets[1], 3)) & (1 << 64) - 1).count("1") > 2
    texts = by_bits + by_sets + [" ".join(f"v{k}" for k in range(200))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 4]


def test_rows_of_groups_stay_where_they_are(spark):
    rows = [(1, "b", "x"), (1, "a", "y"), (1, None, "z"), (2, "c", "x"), (3, "d", "x"), (None, "e", "x"), (None, "e", "x"), (4, None, "x"), (4, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    groups = spark.createDataFrame([(1,), (3,), (4,)], "doc_id long")
    kept = simhash.one_of_each(docs, groups)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(
        [(1, None, "z"), (3, "d", "x"), (4, None, "x"), (None, "e", "x"), (None, "e", "x")], key=str)
    plan = kept._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
