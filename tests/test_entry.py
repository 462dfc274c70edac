"""The registered core queries against their SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

DATA = "/root/testdata/sf0.001"
NAMES = ["p1_found", "p1_attributes", "p3_found", "p3_counts", "p5_found", "p5_grid", "asof_latest", "vintage_history", "dedup_append", "feat_yoy", "feat_volatility", "spread_signal", "degree_digest", "topo_level", "tfidf_topk", "regime_state", "token_f1", "ema_fold", "step_log_report", "stream_hourly"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    import compare

    import __spark_entry__ as entry

    got = entry.queries()[name](spark, DATA).toPandas()
    want = compare.connect(DATA).execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert compare.canonical(got) == compare.canonical(want)


def test_registry_is_consistent():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
