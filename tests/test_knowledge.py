"""Edges, evidence and checks on hand-made rows, with nulls and empty tables."""

import pytest
from pyspark.sql import functions as F

from vintagraph.operators import assess, knowledge, scoring


def test_confidence_machine_clamps(spark):
    e = spark.createDataFrame([("a", i, i % 10 != 0) for i in range(40)] + [("b", i, False) for i in range(9)], "k string, t int, p boolean")
    got = {r.k: r.confidence for r in knowledge.confidence_machine(e, ["k"], ["t"], "p").collect()}
    c = 0.5
    for i in range(40):
        c = min(0.95, c + 0.05 / (i + 1) ** 0.5) if i % 10 else max(0.1, c - 0.08)
    assert got["a"] == pytest.approx(c) and got["b"] == pytest.approx(0.1)


def test_votes(spark):
    r = spark.createDataFrame([("+", "+", None), ("+", "-", "+"), ("+", "-", None), (None, None, None)], "a string, b string, c string")
    sign, score = knowledge.sign_votes([F.col("a"), F.col("b"), F.col("c")])
    assert [tuple(x) for x in r.select(sign, score).collect()] == [("+", 0.9), ("+", 0.6), (None, 0.0), (None, 0.0)]


def test_guard_and_gap(spark):
    e = spark.createDataFrame([("a", "b", 1), ("a", "c", -1), ("a", "d", 0), ("x", "y", 1)], "src string, dst string, sign int")
    rules = spark.createDataFrame([("a", "b", 1), ("a", "c", 1), ("a", "d", 1)], "src string, dst string, rule_sign int")
    assert {(r.dst, r.decision) for r in knowledge.static_guard(e, rules).collect()} == {("b", "strengthen"), ("c", "reject"), ("d", "strengthen"), ("y", "create")}
    assert {(r.dst, r.case) for r in knowledge.gap(e, rules.withColumnRenamed("rule_sign", "sign"), ["src", "dst"]).collect()} == {("b", "same"), ("c", "opposite"), ("d", "opposite"), ("y", "missing")}


def test_spec_match_keeps_unmatched(spark):
    specs = spark.createDataFrame([(1, "one", ["Rate"], None, "affect"), (2, "two", None, ["x"], None)], "ord int, name string, head_has array<string>, tail_has array<string>, rel string")
    e = spark.createDataFrame([(1, "the rate", "x", "AFFECT"), (2, None, None, None)], "id int, head string, tail string, rel string")
    assert {(r.id, r.spec, r.score) for r in knowledge.spec_match(e, specs).collect()} == {(1, "one", 1.0), (2, None, None)}


def test_resolution(spark):
    ents = spark.createDataFrame([("ab_1",), ("cd_2",), ("cd_2",), (None,)], "id string")
    refs = spark.createDataFrame([("ab_1",), (" AB_1 ",), ("ab-1",), ("zz",), (None,), ("",)], "ref string")
    got = {r.ref: (r.entity, r.confidence) for r in assess.resolve(refs, ents).collect()}
    assert got == {"ab_1": ("ab_1", 0.95), " AB_1 ": ("ab_1", 0.9), "ab-1": ("ab_1", 0.85), "zz": (None, 0.5), "": (None, 0.5)}
    assert assess.resolve(refs.limit(0), ents).count() == 0


def test_issues_of_queries_without_hits(spark):
    h = spark.createDataFrame([(1, 0.9), (1, 0.5), (1, 0.95)], "qid int, score double")
    q = spark.createDataFrame([(1,), (2,)], "qid int")
    got = {r.qid: (list(r.issues), r.accurate) for r in assess.result_issues(h, q).collect()}
    assert got == {1: ([], True), 2: (["few", "low", "flat"], False)}


def test_contributions(spark):
    r = spark.createDataFrame([(0.8, "positive"), (0.8, "negative"), (0.0, "positive"), (None, "positive"), (-0.5, "positive")], "v double, d string")
    assert [x[0] for x in r.select(scoring.contribution(F.col("v"), F.col("d"))).collect()] == [1.0, -1.0, 0.0, None, -0.5]


def test_correctness_and_boost(spark):
    r = spark.createDataFrame([("3 kPa now", "3 kPa now"), ("3 kPa", None), (None, "x")], "expected string, generated string")
    assert [round(x.correctness, 3) for x in assess.correctness(r).collect()] == [1.0, 0.0, 1.0]
    h = spark.createDataFrame([("about 5", "is 5"), ("about 5", "is 7"), ("none", "is 7"), (None, None)], "query string, text string")
    assert [round(x.boost, 3) for x in assess.numeric_boost(h).collect()] == [0.2, 0.05, 0.0, 0.0]
