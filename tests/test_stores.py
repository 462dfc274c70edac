"""Stores, contexts, questions and chunkers on small fixtures: nulls, ties, repeats and empty tables included."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from vintagraph.functions import questions as Q
from vintagraph.functions.cache import Cache
from vintagraph.operators import chunking, contexts, features, stores
from vintagraph.sources import readers

DATA = "/root/testdata/sf0.001"


def test_cache_expires_and_evicts():
    now = [0.0]
    c = Cache(2, 10, lambda: now[0])
    c.put("a", 1)
    c.put("b", 2)
    assert c.get("a") == 1
    now[0] = 5
    c.put("c", 3)  # b was never used
    assert c.get("b") is None and c.get("a") == 1 and c.get("c") == 3 and len(c) == 2
    now[0] = 15.5
    assert c.get("a") is None and c.get("none") is None


def test_versions_commit_and_roll_back(spark, tmp_path):
    t = readers.VersionedTable(spark, str(tmp_path / "t"))
    assert t.version() == 0
    with pytest.raises(ValueError):
        t.commit()
    t.stage(spark.range(3))
    assert t.commit() == 1 and t.read().count() == 3
    t.stage(t.read().where("id > 0"))
    t.rollback()
    assert t.version() == 1
    t.stage(t.read().where("id > 0"))
    assert t.commit() == 2 and t.read().count() == 2 and t.read(1).count() == 3


def test_registry_drops_broken_entries(tmp_path):
    p = tmp_path / "f.json"
    p.write_text(json.dumps({"features": [{"feature_id": "a", "feature_type": "raw"}, {"feature_id": ""}, {"feature_type": "raw"}, 7, {"feature_id": None}]}))
    assert readers.read_registry(str(p), ["feature_id", "feature_type"]) == [{"feature_id": "a", "feature_type": "raw"}]


def test_select_only(spark):
    t = spark.createDataFrame([(1, "x")], "n int, s string").withColumn("at", F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"))
    assert [tuple(r) for r in readers.run_select(spark, "SELECT n, at FROM t", {"t": t}).collect()] == [(1, "2024-01-02T03:04:05")]
    for bad in ("DROP TABLE t", "SELECT 1; SELECT 2", ""):
        with pytest.raises(ValueError):
            readers.run_select(spark, bad, {"t": t})


def test_percentile_equals_brute_force(spark):
    r = random.Random(1)
    rows = sorted({(k, r.randrange(40) * 6 * 3_600_000_000) for k in "aab" for _ in range(60)})
    p = [(k, t, float(r.randrange(5)), 9) for k, t in rows] + [(None, 1, 1.0, 9), ("a", None, 1.0, 9), ("a", 3, None, 9)]
    df = spark.createDataFrame(p, "series_id string, t bigint, value double, pct2 int")
    got = {(x.series_id, x.t): x.pct for x in features.percentile(df, 2, factor=1).collect()}
    width = 2 * features.DAY
    for k, t, v, _ in p[:-3]:
        w = [y for a, u, y, _ in p[:-3] if a == k and t - width <= u <= t]
        assert got[k, t] == pytest.approx(sum(y <= v for y in w) / len(w))
    assert len(got) == len(rows) and features.percentile(df.limit(0), 2).count() == 0


def test_features_by_specification(spark):
    p = spark.createDataFrame([("x", 0, 10.0), ("x", features.DAY, 20.0), ("y", 0, 4.0)], "series_id string, t bigint, value double")
    sp = spark.createDataFrame([("f1", "raw", ["x"], 1), ("f2", "roc", ["x"], 1), ("f3", "spread", ["x", "y"], 1), ("f4", "odd", ["x"], 1), (None, "raw", ["x"], 1), ("f5", "raw", None, None)], "feature_id string, feature_type string, input_series array<string>, window_days int")
    got = {(r.feature_id, r.t): r.value for r in features.compute(p, sp).collect()}
    assert got == {("f1", 0): 10.0, ("f1", features.DAY): 20.0, ("f2", features.DAY): 1.0, ("f3", 0): 6.0}
    assert features.compute(p.limit(0), sp).count() == 0 and features.compute(p, sp.limit(0)).count() == 0


def test_windows_cover_the_text():
    r = random.Random(4)
    texts = ["", "a", "word " * 500, "No end here " * 100, "측정값은 12.5 mg/L 이다. " * 80, "".join(r.choice("ab .\n12") for _ in range(3000))]
    for t in texts:
        w = chunking.bounded(t)
        assert "".join(t[max(a, p):b] for (a, b), p in zip(w, [0, *[x[1] for x in w]])) == t
        assert all(b - a <= 434 for a, b in w) and all(a < b for a, b in w)
        for how in (lambda x: chunking.sections(x, r"^No", 200), chunking.articles):
            s = how(t)
            assert "".join(t[a:b] for a, b in s) == t
    law = "제1장 총칙\n제1조 목적이다.\n제2조 정의이다. " + "긴 문장이다. " * 300
    cut = [law[a:b] for a, b in chunking.articles(law)]
    assert cut[0].startswith("제1장") and any(c.startswith("제2조") for c in cut) and max(map(len, cut)) <= 1000


def test_packing_loses_nothing():
    t = "Yes. " + "A longer sentence that goes on for a while and ends. " * 30 + "No."
    out = chunking.pack(t, 300, 0)
    assert " ".join(out) == " ".join(t.split(" ")).strip() and all(len(c) >= 50 for c in out)


def test_merges_and_fallbacks(spark):
    a = spark.createDataFrame([(1, 5, 0.5), (1, 6, 0.1)], "qid int, id int, score double")
    b = spark.createDataFrame([(1, 5, 0.9), (1, 5, 0.9), (2, 1, None)], "qid int, id int, score double")
    m = {(r.qid, r.id): (r.score, r.sources) for r in stores.merge_candidates({"a": a, "b": b}, ["qid", "id"], "score").collect()}
    assert m == {(1, 5): (0.9, ["a", "b"]), (1, 6): (0.1, ["a"]), (2, 1): (None, ["b"])}
    e = spark.createDataFrame([("x", i) for i in range(3)] + [("y", 1)], "k string, v int")
    f = spark.createDataFrame([("x", 9), ("y", 8), ("z", 7)], "k string, v int")
    got = {(r.k, r.v, r.origin) for r in stores.with_fallback(e, f, "k").collect()}
    assert {g for g in got if g[2] == "second"} == {("y", 8, "second"), ("z", 7, "second")} and len(got) == 6


def test_mentions_and_pairs(spark):
    f = spark.createDataFrame([(1, 0, "The free chlorine rose at Pellam."), (1, 1, None), (2, 0, "Pellam, and PELLAM: free  chlorine fell"), (3, 0, "")], "id int, n int, text string")
    names = spark.createDataFrame([("e1", "t", "Free chlorine"), ("e2", "p", "pellam"), ("e2", "p", "pellam"), ("e3", "p", None), ("e4", "p", " ")], "entity string, type string, name string")
    got = {(r.id, r.n, r.entity) for r in stores.mentions(f, names).collect()}
    assert got == {(1, 0, "e1"), (1, 0, "e2"), (2, 0, "e1"), (2, 0, "e2")}
    sign = spark.createDataFrame([(1, 0, "+"), (2, 0, "-")], "id int, n int, sign string")
    p = {(r["head"], r["tail"], r["sign"], r["n_fragments"]) for r in stores.pair_mentions(stores.mentions(f, names), sign).collect()}
    assert p == {("e1", "e2", "+", 1), ("e1", "e2", "-", 1)}
    assert stores.mentions(f.limit(0), names).count() == 0 and stores.mentions(f, names.limit(0)).count() == 0


def test_selection_prefers_difference(spark):
    h = spark.createDataFrame([(1, 1, 0.9, "a b c"), (1, 2, 0.9, "a b c"), (1, 3, 0.5, "d e f"), (2, 7, 0.1, None)], "qid bigint, id bigint, score double, text string")
    got = {(r.qid, r.pos): r.id for r in contexts.select_diverse(h, 2, 0.5).collect()}
    assert got == {(1, 1): 1, (1, 2): 3, (2, 1): 7}
    assert {r.id for r in contexts.select_diverse(h, 5, 0.9, 0.2).where("qid = 1").collect()} == {1, 3}
    assert contexts.select_diverse(h.limit(0)).count() == 0


def test_unsupported_claims(spark):
    r = spark.createDataFrame([(1, "what is the limit", "the limit is 5 mg/L", "the limit is 7 mg/L"), (2, "what is the limit", "the limit is 5 mg/L", "the limit is 5 mg/L"), (3, "q", None, None)], "id int, question string, context string, answer string")
    got = {x.id: (x.signs, x.flagged) for x in contexts.unsupported(r, ["perhaps"], ["in general"]).collect()}
    assert got[1] == (["number"], True) and got[2] == ([], False) and got[3] == ([], False)


def test_questions(spark):
    df = spark.createDataFrame([("버들 교차로에서", "상위 3 평균 10 이상 월별"), (" ", None), (None, "v2.1 on 2024-01-02 at 10:30 for AB-12 and 7")], "p string, q string")
    s = Q.slots("q")
    got = df.select(Q.place("p").alias("place"), Q.quantities("q").alias("n"), Q.statement("t", "v", "ts", s).alias("sql"), Q.route("q", [("x", ["월별"])], {"a": ["on"], "b": ["zz"]}, "none").alias("r")).collect()
    assert got[0].place == "버들 교차로" and got[1].place is None and got[2].n == ["7"]
    assert got[0].sql == "SELECT date_trunc('month', ts) AS period, avg(v) AS result FROM t WHERE v >= 10.0 GROUP BY date_trunc('month', ts) ORDER BY result DESC LIMIT 3"
    assert [g.r for g in got] == ["x", "none", "a"]


def test_breaks_and_states(spark):
    df = spark.createDataFrame([(1.0, ">", 0.5), (None, ">", 0.5), (1.0, "==", 1.0), (0.5, "<=", 0.5)], "v double, op string, lim double")
    assert [r[0] for r in df.select(stores.break_condition(F.col("v"), F.col("op"), F.col("lim"))).collect()] == [True, False, False, True]
    st = spark.createDataFrame([(1, "a"), (5, "b"), (5, "a"), (9, "c")], "t int, s string")
    assert [tuple(r) for r in stores.state_at(st, F.lit(7), "t", ["s"]).collect()] == [(5, "b")]
    assert stores.state_at(st.limit(0), F.lit(7), "t", ["s"]).count() == 0
    e = spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "q")], "src string, dst string")
    assert stores.delete_nodes(e, spark.createDataFrame([("y",)], "node string")).count() == 1
    old = spark.createDataFrame([("a", 1, "o"), (None, 1, "o")], "k string, at int, v string")
    new = spark.createDataFrame([("a", 1, "n"), ("b", 0, "n")], "k string, at int, v string")
    assert {(r.k, r.v) for r in stores.upsert_relations(old, new, ["k"], "at").collect()} == {("a", "n"), ("b", "n")}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_queries_without_sql_run(spark):
    import __spark_entry__ as entry

    for name in ("extraction_mentions", "extraction_pipeline", "filter_quality", "context_select", "hybrid_search", "document_pipeline", "chunk_bounded", "chunk_process", "chunk_articles"):
        assert entry.queries()[name](spark, DATA).count() >= 0, name
