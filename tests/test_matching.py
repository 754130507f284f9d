"""Phrase search by automaton against plain containment."""

import random

import pytest
from pyspark.sql import functions as F

from archivolt.operators.matching import found_phrases


@pytest.mark.parametrize("budget", [1_000_000, 40, 1])
def test_found_phrases_are_the_contained_ones(spark, budget):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choice("ab 金沙") for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(3, "bab"), (100, None), (101, ""), (102, "x" * 50_000 + "needle")]
    parts = [(i, "".join(rng.choice("ab 金沙") for _ in range(rng.randint(1, 4)))) for i in range(40)] + [(50, ""), (51, None), (52, "needle"), (53, "needle"), (50, "ba"), (54, "nowhere at all")]
    docs, phrases = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(parts, "eid long, part string")
    want = {(d, e) for d, t in texts for e, p in parts if t is not None and p is not None and p in t}
    got = [tuple(r) for r in found_phrases(docs, phrases, budget).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_ids_may_be_structures_and_tables_empty(spark):
    docs = spark.createDataFrame([(1, "a", "one two")], "n long, s string, text string").select(F.struct("n", "s").alias("doc_id"), "text")
    phrases = spark.createDataFrame([(7, "two")], "q long, part string").select(F.struct("q").alias("eid"), "part")
    assert [(r["doc_id"]["n"], r["eid"]["q"]) for r in found_phrases(docs, phrases).collect()] == [(1, 7)]
    assert found_phrases(docs, phrases.where("part = ''")).count() == 0 and found_phrases(docs.limit(0), phrases).count() == 0


def test_texts_are_neither_shuffled_nor_exploded(spark):
    docs, phrases = spark.range(5).selectExpr("id AS doc_id", "'text' AS text"), spark.range(2).selectExpr("id AS eid", "'ex' AS part")
    plan = found_phrases(docs, phrases)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan
