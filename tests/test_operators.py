"""Hand-computed cases of the other operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintagraph.functions import text as T
from vintagraph.operators import bitemporal, chunking, features, folds, graph, metrics, pairs, retrieval, scoring
from vintagraph.plans import nlsql
from vintagraph.sources import readers
from vintagraph.streaming import stateful

DAY = features.DAY


def d(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_vintages(spark):
    o = spark.createDataFrame([("A", d(0), d(1), 10.0), ("A", d(0), d(3), 12.0), ("A", d(1), d(2), 20.0), ("A", d(1), None, 99.0)], "series_id string, timestamp timestamp, as_of timestamp, value double")
    read = lambda n: {(r.timestamp, r.value) for r in bitemporal.as_of_read(o, d(n)).collect()}
    assert read(0) == set() and read(2) == {(d(0), 10.0), (d(1), 20.0)} and read(3) == {(d(0), 12.0), (d(1), 20.0)}
    assert [r.vintage for r in bitemporal.versions(o).where("value >= 10").orderBy("timestamp", "vintage").collect()] == [1, 2, 1]
    with pytest.raises(bitemporal.LookAheadError):
        bitemporal.guard(d(3), d(2))
    with pytest.raises(bitemporal.LookAheadError):
        bitemporal.as_of_read(o, None)
    bitemporal.guard(d(3), d(2), replay=False)


def test_append_is_idempotent(spark):
    b = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "k string, o int")
    assert sorted(r.k or "" for r in bitemporal.append_new(b.where("k = 'b'"), b, ["k"], ["o"]).collect()) == ["", "a"]


def test_range_edges(spark):
    p = spark.createDataFrame([("s", 0, 1.0), ("s", 30 * DAY, 2.0), ("s", 31 * DAY, 4.0), ("t", 5, 1.0)], "series_id string, t bigint, value double")
    roc = {r.t // DAY: r.roc for r in features.change(p, 30).collect()}
    assert roc == {30: 1.0, 31: 3.0}
    z = {r.t: r.z for r in features.zscore(p, 30).collect()}
    assert set(z) == {30 * DAY, 31 * DAY} and z[30 * DAY] == pytest.approx(1.0)
    same = spark.createDataFrame([("s", i * DAY, 5.0) for i in range(3)], "series_id string, t bigint, value double")
    assert [r.z for r in features.zscore(same, 30).collect()] == [0.0, 0.0]
    xy = same.select(F.col("series_id").alias("pair"), "t", F.col("value").alias("x"), F.col("value").alias("y"))
    assert features.correlation(xy, 30).count() == 0
    assert features.change(p.limit(0), 30).count() == 0


def test_rolling_over_blocks_is_exact(spark):
    rng = np.random.default_rng(5)
    t = np.cumsum(rng.integers(1, 40, 600)) * (DAY // 24)
    p = spark.createDataFrame([("s", int(a), float(b)) for a, b in zip(t, rng.normal(size=600))], "series_id string, t bigint, value double")
    got = {r.t: r.n for r in features.rolling(p, 5, {"n": lambda w: F.count("value").over(w)}, factor=2).collect()}
    assert got == {int(a): int(((t <= a) & (t >= a - 5 * DAY)).sum()) for a in t}


def test_ema_fixture_and_blocks(spark, monkeypatch):
    s, v = folds.fold(np.array([1.0, 0.0, 1.0]))
    assert s == pytest.approx([1, 0.8, 0.84]) and v == pytest.approx([0, 0.2, 0.2])
    monkeypatch.setattr(folds, "BLOCK", 300)
    x = np.random.default_rng(1).normal(size=2000)
    e = spark.createDataFrame([("k", i, i, float(a)) for i, a in enumerate(x)] + [("k", 5, 9999, None)], "k string, t bigint, id bigint, x double")
    got = {r.id: (r.score, r.volatility) for r in folds.ema(e, "k", "t", "id", "x").collect()}
    s, v = folds.fold(x)
    assert len(got) == 2000 and all(got[i] == pytest.approx((s[i], v[i]), abs=1e-12) for i in range(2000))


def test_signed_paths(spark):
    e = spark.createDataFrame([("a", "b", "x", 1, 0.5), ("b", "c", "x", -1, 0.4), ("a", "c", "x", 1, 0.1)], "src string, dst string, rel string, sign int, weight double")
    p = graph.simple_paths(e, spark.createDataFrame([("a", "c")], "src string, dst string"), 4)
    v = graph.path_verdict(p).first()
    assert (v.sign, v.conflicts) == ("-", 1) and v.confidence == pytest.approx(1 / 3)
    chain = spark.range(40).selectExpr("id src", "id + 1 dst")
    assert graph.levels(chain).agg({"level": "max"}).first()[0] == 40 and graph.levels(chain.limit(0)).count() == 0
    assert {r.node: r.level for r in graph.levels(e).collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(e.unionByName(e.selectExpr("dst src", "src dst", "rel", "sign", "weight")), depth=5).count()
    r = graph.reach(e, spark.createDataFrame([("a",)], "seed string"), 3)
    assert {x.node: x.level for x in r.collect()} == {"a": 0, "b": 1, "c": 1}


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "alphabet"), (4, ""), (5, None)], "id bigint, text string").where("text is not null")
    q = spark.createDataFrame([(1, "alpha")], "qid bigint, query string")
    r = {x.id: x.score for x in retrieval.bm25(docs, q).collect()}
    assert set(r) == {1, 3} and r[1] > r[3]
    lists = [spark.createDataFrame(x, "qid bigint, id bigint, rank int") for x in ([(1, 10, 1), (1, 11, 2)], [(1, 11, 1), (1, 12, 2)])]
    f = {x.id: x.score for x in retrieval.rrf([(lists[0], 1.0), (lists[1], 1.0)]).collect()}
    assert f[11] == pytest.approx(1 / 62 + 1 / 61)


def test_greedy_dedup_keeps_a_and_c(spark):
    a = "the quick brown fox jumps over the lazy dog and runs away today"
    b, c = a + " x", "x y" + a[3:-9] + " zzzz yyyy xxxx"
    h = spark.createDataFrame([(1, 1, 1, a), (1, 2, 2, b), (1, 3, 3, c), (1, 4, 4, "short")], "qid bigint, id bigint, rank int, text string")
    assert sorted(r.id for r in retrieval.greedy_dedup(h).collect()) == [1, 3]


def test_ranking(spark):
    r = spark.createDataFrame([(1, 1, 1, True), (1, 2, 2, False), (1, 3, 3, True)], "qid bigint, id bigint, rank int, relevant boolean")
    m = metrics.ranking(r, 3).first()
    assert m.ndcg == pytest.approx((1 + 1 / math.log2(4)) / (1 + 1 / math.log2(3))) and m.mrr == 1.0 and m.ap == pytest.approx((1 + 2 / 3) / 2)
    assert metrics.ranking(r.where("not relevant"), 3).first().ndcg == 0


def test_answers(spark):
    r = spark.createDataFrame([("a b c", "a b d"), (None, "x"), ("x", None), ("", "")], "expected string, generated string")
    f = [x.f1 for x in metrics.token_f1(r).collect()]
    assert f[0] == pytest.approx(2 / 3) and f[1:] == [0, 0, 0]
    assert metrics.lcs(list("abcd"), list("xbyd")) == 2
    assert [round(x.rouge_l, 3) for x in metrics.rouge_l(r).collect()] == [0.667, 0, 0, 0]


def test_half_life_is_clamped(spark):
    s = spark.createDataFrame([("a", "b", i, float((-1) ** i)) for i in range(20)], "a string, b string, dt int, spread double")
    assert pairs.half_life(s).first().half_life == 1.0
    up = spark.createDataFrame([("a", "b", i, 2.0**i) for i in range(10)], "a string, b string, dt int, spread double")
    assert pairs.half_life(up).first().half_life is None


def test_positions(spark):
    z = [0.0, 2.0, 1.0, -0.1, 0.0, -2.0, -1.0, 0.2]
    s = spark.createDataFrame([("a", "b", i, x, x) for i, x in enumerate(z)], "a string, b string, dt int, spread double, z double")
    t = [(r.entry_dt, r.exit_dt, r.side) for r in pairs.positions(s).orderBy("entry_dt").collect()]
    assert t == [(1, 3, -1), (5, 7, 1)]


def test_conditions(spark):
    r = spark.createDataFrame([(5.0, ">", 4.0, None), (None, ">", 4.0, None), (5.0, "?", 4.0, None), (5.0, "between", 5.0, 6.0)], "v double, op string, lo double, hi double")
    assert [x[0] for x in r.select(scoring.condition(F.col("v"), F.col("op"), F.col("lo"), F.col("hi"))).collect()] == [True, False, False, True]


def test_text(spark):
    r = spark.createDataFrame([("a–b \t c\x00\n\n\n\nd",), (None,)], "t string")
    assert [x[0] for x in r.select(T.clean("t")).collect()] == ["a-b c\n\nd", None]
    assert [len(x[0]) for x in r.select(T.ngrams("t")).collect()][1] == 0
    one = spark.createDataFrame([("2024년 3월 5일 유량 1,234.5 m3/h, 12 분", "1700000000")], "t string, e string").select(T.iso_date("t"), T.measurements("t"), T.parse_timestamp("e"), T.parse_value(F.lit("n/a"))).first()
    assert one[0] == "2024-03-05" and one[1][-2:] == ["1,234.5 m3/h", "12 분"] and one[2].year == 2023 and one[3] is None


def test_chunkers(spark):
    t = "Sentence one is here. " * 100
    w = chunking.slide(t)
    assert w[0][0] == 0 and w[-1][1] == len(t) and all(b - a <= 802 for a, b in w) and t[w[0][1] - 1] == "."
    assert chunking.slide("") == [] and chunking.slide("short") == [(0, 5)]
    assert all(len(c) <= 700 for c in chunking.pack(t))
    l = spark.createDataFrame([(1, "머리\n제1조 가\n나\n제2조 다"), (2, None)], "id bigint, text string")
    assert {(r.article, r.n_lines) for r in chunking.legal(l).collect()} == {(0, 1), (1, 2), (2, 1)}


def test_legal_numbers_of_any_length(spark):
    far = "9" * 40
    t = f"머리\n\n제1조 가\n제99999999999조 나\n다\n\n제{far}조 라\n제{far}9조 마\n 제{'0' * 30}1조 바\n제2147483647조 사\n제0조 아\n"
    l = spark.createDataFrame([(1, t), (2, ""), (3, "\n" * 5), (4, None)], "id bigint, text string")
    rows = chunking.legal(l).collect()
    assert sorted((r.id, r.article or 0, r.n_lines, r.text) for r in rows) == [
        (1, 0, 1, f"제{far}9조 마"), (1, 0, 1, f"제{far}조 라"), (1, 0, 4, "머리\n\n제0조 아\n"), (1, 1, 2, f"제1조 가\n 제{'0' * 30}1조 바"),
        (1, 2147483647, 1, "제2147483647조 사"), (1, 99999999999, 3, "제99999999999조 나\n다\n"), (2, 0, 1, ""), (3, 0, 6, "\n" * 5),
    ]
    assert sorted(r.text for r in rows if r.article is None) == [f"제{far}9조 마", f"제{far}조 라"]


def test_questions():
    day = dt.date(2024, 3, 31)
    assert nlsql.date_range("last month", day) == (dt.date(2024, 2, 1), dt.date(2024, 3, 1))
    assert nlsql.date_range("지난 주", day) == (dt.date(2024, 3, 18), dt.date(2024, 3, 25))
    assert nlsql.date_range("nothing", day) is None
    assert nlsql.is_safe("select a from b") and not nlsql.is_safe("select a from b; drop table b") and not nlsql.is_safe("update b set a = 1")
    with pytest.raises(ValueError, match="no table"):
        nlsql.parse("what is the weather")


def test_step_lines(spark):
    l = spark.createDataFrame([("2024-01-01 10:00:00 | [session_a] search : 1.25초 | top 5",), ("noise",), (None,)], "value string")
    assert [(r.session, r.step, r.seconds, r.details) for r in readers.parse_steps(l).collect()] == [("session_a", "search", 1.25, "top 5")]


def test_stream_appends_once(spark, tmp_path):
    src = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, o int")
    src.write.parquet(str(tmp_path / "in"))
    for n in range(2):
        s = stateful.read_new(spark, str(tmp_path / "in"), src.schema)
        stateful.append_once(s, str(tmp_path / "store"), ["k"], ["o"], str(tmp_path / f"c{n}")).awaitTermination()
    assert sorted((r.k, r.o) for r in spark.read.parquet(str(tmp_path / "store")).collect()) == [("a", 1), ("b", 1)]


def test_chunk_files(spark, tmp_path):
    c = spark.createDataFrame([("d", "f", 1, 0, 3, "글", {"a": "b"}), ("e", None, None, None, None, "", None)], readers.CHUNKS)
    readers.write_chunks(c, str(tmp_path / "x"))
    assert sorted(map(str, readers.read_chunks(spark, str(tmp_path / "x")).collect())) == sorted(map(str, c.collect()))


def test_pairs_without_trades(spark):
    s = spark.createDataFrame([("a", "b", i, 0.0, 0.1) for i in range(5)], "a string, b string, dt int, spread double, z double")
    assert pairs.positions(s).count() == 0
    assert pairs.positions(s.limit(0)).count() == 0
