"""Queries that read the whole of a growing table, against their SQL on the smallest tables and against brute force."""

import datetime as dt
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintagraph.operators import blocks, folds, graph, known, spikes

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))
DATA = "/root/testdata/sf0.001"
KG = ["kg_paths", "kg_path_verdicts", "kg_path_scores", "kg_path_consistency", "kg_propagation", "kg_two_hop_shock", "kg_reachability", "kg_reach_by_type", "kg_scenario_paths"]


def equals_sql(spark, name):
    import compare

    import __spark_entry__ as entry

    got = entry.queries()[name](spark, DATA).toPandas()
    want = compare.connect(DATA).execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert compare.canonical(got) == compare.canonical(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", KG)
def test_relations_query_equals_sql(spark, name):
    equals_sql(spark, name)


def test_all_paths_equal_brute_force(spark):
    e = [("hub", f"n{i}", 0.5, -1) for i in range(40)] + [(f"n{i}", f"n{(i * 7 + 1) % 40}", 0.0, 1) for i in range(40)] + [("n3", "hub", 0.9, 1), ("n3", "n3", 1.0, 1), ("n3", "n5", 0.2, 0), ("n3", "n5", 0.3, 1)]
    df = spark.createDataFrame([(a, b, "r", s, w) for a, b, w, s in e], "src string, dst string, rel string, sign int, weight double")
    want, front = [], [((a,), 1.0, 1) for a in {x[0] for x in e}]
    for _ in range(3):
        front = [((*p, b), x * max(w, 0.01), g * s) for p, x, g in front for a, b, w, s in e if a == p[-1] and b not in p]
        want += front
    got = [(tuple(r.path), round(r.strength, 9), r.sign) for r in graph.all_paths(df, 3).collect()]
    assert sorted(got) == sorted((p, round(x, 9), g) for p, x, g in want)
    assert graph.all_paths(df.limit(0), 3).count() == 0


def burst(n, after):
    """Times in micros: one reading far before the others, ``n`` readings in a burst, ``after`` readings days apart."""
    last = 1_700_000_000_000_000
    return [0, *range(last, last + n), *(last + n + i * 86_400_000_000 for i in range(1, after + 1))]


def test_blocks_are_even(spark):
    far = 253_370_764_800_000_000  # in the year 9999
    odd = {"a burst": burst(9000, 50), "one far time": [*range(20_000), far], "one instant": [*range(1000), *[5_000] * 50_000], "a third in a second": [*range(0, 20_000 * 10**6, 10**6), *range(7 * 10**9, 7 * 10**9 + 10_000)]}
    for name, times in odd.items():
        df = spark.createDataFrame([("k", x, i) for i, x in enumerate(times)], "k string, t bigint, id int")
        b = blocks.with_blocks(df, "k", "t", 256, ("id",))
        r = b.groupBy("block").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("block").collect()
        assert sum(x.n for x in r) == len(times) and max(x.n for x in r) <= 256, name
        assert all(x.hi <= y.lo for x, y in zip(r, r[1:])), name
        assert max(x["count"] for x in b.groupBy(F.spark_partition_id()).count().collect()) <= 2 * max(blocks.LEAST, len(times) / 8), name


def test_known_among_very_many_versions_of_an_instant(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PART", 2000)
    h = spark.range(50_000).selectExpr("'a' s", "100L t", "id + 10 k")
    e = spark.createDataFrame([(1, "a", 100, 25_000), (2, "a", 99, 25_000), (3, "a", 200, 9), (4, "a", 300, 10), (5, "a", 10**17, 10**17)], "e int, s string, t bigint, k bigint")
    got = {r.e: (r.known_t, r.known_k, r.final_k) for r in known.match_known(e, h, "e", "s", "t", "k").collect()}
    assert got == {1: (100, 25_000, 50_009), 2: (None, None, None), 3: (None, None, 50_009), 4: (100, 10, 50_009), 5: (100, 50_009, 50_009)}


def test_context_crosses_gaps_and_small_blocks(spark):
    at = [0] * 5 + [3] * 2 + [4] + [9] * 6  # block of each row
    df = spark.createDataFrame([("k", i, b) for i, b in enumerate(at)], "k string, t bigint, block bigint")
    got = {}
    for r in blocks.with_context(df, "k", "t", 4, 3).collect():
        got.setdefault(r.to, set()).add(r.t)
    assert got == {0: set(range(8)), 3: set(range(1, 10)), 4: set(range(3, 11)), 9: set(range(4, 14))}


def test_stuck_run_and_average_across_a_burst(spark):
    rng = np.random.default_rng(5)
    t = burst(9000, 40)
    v = 50 + np.cumsum(rng.normal(0, 0.1, len(t)))
    v[8995:9008] = v[8995]  # six readings of the run in the burst, seven after it
    when = [dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=x) for x in t]
    obs = spark.createDataFrame([(f"o{i}", "s", x, x, float(y), "ok") for i, (x, y) in enumerate(zip(when, v))], "observation_id string, series_id string, timestamp timestamp_ntz, as_of timestamp_ntz, value double, quality_flag string")
    lim = spark.createDataFrame([("s", None, None)], "series_id string, min_possible double, max_possible double")
    found = {r.observation_id for r in spikes.implausible(obs, lim).collect() if r.kind == "stuck"}
    assert found == {f"o{i}" for i in range(8995, 9008)}
    e = spark.createDataFrame([("s", x, i, float(y)) for i, (x, y) in enumerate(zip(t, v))], "k string, t bigint, id bigint, x double")
    got = {r.id: r.score for r in folds.ema(e, "k", "t", "id", "x").collect()}
    want, _ = folds.fold(v)
    assert len(got) == len(t) and all(abs(got[i] - want[i]) < 1e-9 for i in range(len(t)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_versions_equal_sql(spark):
    equals_sql(spark, "p1_versions")


def test_events_without_a_version_stay(spark):
    h = spark.createDataFrame([("a", 1, 1, "x"), ("b", 2, 9, "z")], "s string, t bigint, k bigint, p string")
    e = spark.createDataFrame([(1, "a", 5, 5), (1, "b", 5, 5), (2, "b", 5, 9), (3, "c", 1, 1), (4, "a", 5, None)], "e int, s string, t bigint, k bigint")
    m = known.with_payload(known.match_known(e, h, "e", "s", "t", "k"), h, "s", "t", "k", "p", every=True)
    got = {r.e: r.attributes for r in known.pivot_known(m, "e", "s", every=True).collect()}
    assert got == {1: {"a": "x", "b": None}, 2: {"b": "z"}, 3: {"c": None}, 4: {"a": None}}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", ["asof_latest_newest", "last_value_newest", "feature_latest_values_newest", "snapshot_newest", "live_replay_newest", "affected_features_newest", "replay_all_steps"])
def test_newest_query_equals_sql(spark, name):
    equals_sql(spark, name)


def test_running_sum_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PART", 50)
    df = spark.range(1000).selectExpr("id", "if(id % 4 = 0, id % 7, 0) k", "case when id % 5 = 0 then null else id - 400 end n", "1 one")
    rows = sorted((r.k, r.id, r.n or 0) for r in df.collect())
    for key in (None, "k"):
        got = [(r.k, r.id, r.s, r.c) for r in blocks.running_sum(df, ["id"] if key else ["k", "id"], {"s": "n", "c": "one"}, key).orderBy("k", "id").collect()]
        total, n, want, last = 0, 0, [], None
        for k, i, x in rows:
            total, n = (x, 1) if key and k != last else (total + x, n + 1)
            last = k
            want.append((k, i, total, n))
        assert got == want
    assert blocks.running_sum(df.limit(0), ["id"], {"s": "n"}, "k").count() == 0
