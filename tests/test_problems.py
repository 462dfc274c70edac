"""The general training-data problems against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import datetime as dt
import random

import numpy as np
import pytest

from vintagraph.operators import blocks, grid, known, references, spikes

OBS = "observation_id string, series_id string, timestamp timestamp, as_of timestamp, value double, quality_flag string"
T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def brute(events, history):
    out = set()
    for e, a, t, k in events:
        h = [(x, y) for b, x, y in history if b == a and None not in (b, x, y) and t is not None and x <= t]
        seen = [(x, y) for x, y in h if k is not None and y <= k]
        out.add((e, a, *(max(seen) if seen else (None, None)), *(max(h) if h else (None, None))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_known_matches_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(blocks, "PART", 20)
    r = random.Random(seed)
    history = [(r.choice("aaab"), r.randrange(300), r.randrange(900)) for _ in range(500)]  # much arrives late, with ties
    history += [("a", None, 5), (None, 3, 4), ("a", 7, None), ("a", 10, 10), ("a", 10, 10)]
    events = [(i, r.choice("abc"), r.randrange(-10, 320), r.choice([None, r.randrange(1000)])) for i in range(200)] + [(900, None, 5, 5), (901, "a", None, 5)]
    h = spark.createDataFrame([(*x, "p", 1) for x in history], "s string, t bigint, k bigint, payload string, block int")
    e = spark.createDataFrame([(*x, 0) for x in events], "e int, s string, t bigint, k bigint, block int")
    got = {tuple(x) for x in known.match_known(e, h, "e", "s", "t", "k").collect()}
    assert got == brute(events, history)


def test_known_payload_and_pivot(spark):
    h = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 1, "y"), ("b", 2, 9, "z")], "s string, t bigint, k bigint, p string")
    e = spark.createDataFrame([(1, "a", 5, 5), (1, "b", 5, 5), (2, "b", 5, 9), (3, "c", 1, 1)], "e int, s string, t bigint, k bigint")
    m = known.with_payload(known.match_known(e, h, "e", "s", "t", "k"), h, "s", "t", "k", "p")
    assert {r.e: r.attributes for r in known.pivot_known(m, "e", "s").collect()} == {1: {"a": "y"}, 2: {"b": "z"}}


def test_known_empty(spark):
    h = spark.createDataFrame([], "s string, t bigint, k bigint")
    e = spark.createDataFrame([(1, "a", 5, 5)], "e int, s string, t bigint, k bigint")
    assert [tuple(r) for r in known.match_known(e, h, "e", "s", "t", "k").collect()] == [(1, "a", None, None, None, None)]
    assert known.match_known(e.limit(0), h, "e", "s", "t", "k").count() == 0


def test_blocks_bound_a_hot_key(spark):
    df = spark.range(20_000).selectExpr("case when id % 10 < 9 then 'hot' else 'cold' end k", "id * id t")
    b = blocks.with_blocks(df, "k", "t", 256)
    sizes = [r["count"] for r in b.groupBy("k", "block").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 2 * 256 and len(sizes) > 60


def test_orphans(spark):
    rel = [(1, " A ", "b", at(10)), (1, " A ", "b", at(10)), (2, "a", "x", at(50)), (3, None, " ", at(50)), (4, "b", "a", at(25)), (5, "c", "d", None), (6, "d", "a", at(5))]
    ent = [("a", at(0), at(20)), ("A", at(30), None), ("b", at(40), None), ("b", at(40), None), ("d", at(1), at(5)), (None, at(0), None), ("e", at(9), at(3))]
    r = spark.createDataFrame([(*x, "z") for x in rel], "relation_id int, head_id string, tail_id string, created_at timestamp, reason string")
    e = spark.createDataFrame(ent, "id string, created_at timestamp, deleted_at timestamp")
    refs = references.references(r, "relation_id", {"head": "head_id", "tail": "tail_id"}, "created_at", "relations")
    found = references.orphans(refs, e, "id", "created_at", "deleted_at")
    got = {(x.row_id, x.endpoint, x.reason) for x in found.collect()}
    assert got == {(1, "tail", "late"), (2, "tail", "missing"), (4, "head", "late"), (4, "tail", "deleted"), (5, "head", "missing"), (6, "head", "deleted")}
    counts = {(c.endpoint, c.month, c.reason): (c.n_orphans, c.n_refs) for c in references.orphan_counts(found, refs).collect()}
    assert counts["tail", "2024-01", "late"] == (1, 4) and counts["head", None, "missing"] == (1, 1)
    assert references.orphans(refs, e.limit(0), "id", "created_at", "deleted_at").count() == refs.count()
    assert references.orphans(refs.limit(0), e, "id", "created_at", "deleted_at").count() == 0


def test_grid(spark):
    rows = [("o1", "s", at(5), at(5), 10.0, "ok"), ("o2", "s", at(15), at(15), 20.0, None), ("o2", "s", at(15), at(16), 30.0, "OK "), ("o3", "s", at(95), at(95), 1.0, "ok"), ("o4", "s", at(55), at(55), 9.0, " Missing"), ("o5", "s", at(55), None, None, "ok"), ("o6", "s", at(56), at(56), float("nan"), "ok"), ("o7", None, at(5), at(5), 1.0, "ok"), ("o8", "t", at(5), at(5), 1.0, "ok")]
    obs = spark.createDataFrame([(*r, 7) for r in rows], OBS + ", step int")
    steps = spark.createDataFrame([("s", 10), ("s", 10), ("u", 10), ("t", None)], "series_id string, step_seconds int")
    got = {r.period_start - int(T0.replace(tzinfo=dt.UTC).timestamp()): r for r in grid.regular_grid(obs, steps, hold=3).collect()}
    assert sorted(got) == list(range(0, 100, 10))
    assert (got[0].value, got[0].coverage, got[0].status) == (10.0, 0.5, "observed")
    assert got[10].value == pytest.approx(20.0) and got[10].n_readings == 1  # 5 s of 10, 5 s of 30
    assert (got[40].status, got[40].coverage, got[50].status, got[50].value) == ("filled", 0.5, "gap", None)
    assert grid.regular_grid(obs.limit(0), steps).count() == 0


def test_chart():
    v = np.array([1.0, 1.1, 1.0, 5.0, 5.1, 1.05, 1.0, 1.1, 9.0, 9.0, 9.1, 9.0, 9.1, 9.0, 1.0])
    s = spikes.chart(v, 0.1, False)
    assert list(np.flatnonzero(s)) == [3, 4]  # the level of 9 lasts; the last reading has nothing after it
    assert not spikes.chart(np.array([]), 1.0, False).any() and not spikes.chart(v, 0.0, False).any()
    assert list(spikes.stuck(np.array([1.0] * 8 + [2.0] * 7))) == [True] * 8 + [False] * 7


def test_limits_follow_the_series():
    rng = np.random.default_rng(11)
    size = np.geomspace(0.1, 4.0, 6000)  # changes grow fortyfold
    v = 50 + np.cumsum(rng.normal(0, 1, 6000) * size) * 0.2
    at = [200, 900, 2500, 4000, 5500]
    v[at] += 15 * size[at] * 0.2
    usual = float(np.median(np.abs(np.diff(v[:128]))))
    found = set(np.flatnonzero(spikes.chart(v, usual, False)).tolist())
    frozen = set(np.flatnonzero(spikes.chart(v, usual, False, alpha=0.0)).tolist())
    assert len(found & set(at)) >= 4 and len(found - set(at)) <= 1
    assert len(frozen - set(at)) > 20 or len(frozen & set(at)) < 3


def test_spikes_do_not_depend_on_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = 50 + np.cumsum(rng.normal(0, 0.1, 3000))
    v[[100, 101, 900, 2047, 2999]] += 40
    v[1500:1540] = v[1500]
    rows = [(f"o{i}", "s", at(i * 7), at(i * 7 + 1), float(x), "ok") for i, x in enumerate(v)]
    rows += [("r", "s", at(700), at(9_000), 1e9, "ok"), ("n", "s", at(3), at(4), None, "ok"), ("x", "s", at(4), None, float("nan"), None), rows[100], ("y", None, at(1), at(1), 1.0, "ok")]
    obs = spark.createDataFrame(rows, OBS)
    lim = spark.createDataFrame([("s", None, 1e6), ("u", 0.0, None)], "series_id string, min_possible double, max_possible double")
    got = {}
    for size in (4096, 256):
        monkeypatch.setattr(spikes, "BLOCK", size)
        got[size] = {(r.observation_id, r.kind) for r in spikes.implausible(obs, lim).collect()}
    assert got[4096] == got[256]
    assert {i for i, k in got[256] if k == "spike"} == {"o100", "o101", "o900", "o2047"}
    assert {i for i, k in got[256] if k == "stuck"} == {f"o{i}" for i in range(1500, 1540)}
    assert {i for i, k in got[256] if k == "impossible"} == {"r"}
    assert spikes.implausible(obs.limit(0), lim).count() == 0
