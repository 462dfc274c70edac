"""The as-of queries at the newest times of the data, where those of ``series`` and ``assess`` have fixed times."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vintagraph.operators import bitemporal as B
from vintagraph.operators import features as X
from vintagraph.plans import series
from vintagraph.plans.registry import Registry
from vintagraph.session import micros
from vintagraph.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _sql(name: str) -> str:
    newest = "(SELECT max(as_of) FROM observations)"
    return series.SQL[name].replace(f"TIMESTAMP '{series.AS_OF}'", newest).replace(f"TIMESTAMP '{series.EARLIER}'", f"({newest} - INTERVAL 3 HOUR)")


def _times(s, d):
    """Columns: the newest as_of of the observations, and three hours before."""
    new = series.obs(s, d).agg(F.max("as_of").alias("m")).select("m", F.expr("m - interval 3 hours").alias("e")).first()
    return tuple(F.lit(x).cast("timestamp_ntz") for x in new)


@query(_sql("asof_latest"))
def asof_latest_newest(s, d):
    return B.as_of_read(series.obs(s, d), _times(s, d)[0])


@query(_sql("last_value"))
def last_value_newest(s, d):
    return B.last_value(series.obs(s, d), _times(s, d)[0])


@query(_sql("feature_latest_values"))
def feature_latest_values_newest(s, d):
    return B.last_value(table(s, d, "feature_values"), _times(s, d)[0], key="feature_id")


@query(_sql("snapshot_at"))
def snapshot_newest(s, d):
    return B.snapshot({"series": (series.obs(s, d), "as_of", ["series_id"], ["observation_id"]), "feature": (table(s, d, "feature_values"), "as_of", ["feature_id"], ["feature_value_id"])}, _times(s, d)[0])


@query(_sql("live_replay_compare"))
def live_replay_newest(s, d):
    o, (at, _) = series.obs(s, d), _times(s, d)
    return B.compare_runs(B.last_value(o, at), B.last_value(o, at, bound_time=True), "series_id", "value")


@query(_sql("scalar_deltas"))
def scalar_deltas_newest(s, d):
    o, (at, before) = series.obs(s, d), _times(s, d)
    old, new = (B.as_of_read(o, x).withColumn("value", B.safe("value")) for x in (before, at))
    return X.deltas(old, new, ["series_id", "timestamp"], "value")


@query(_sql("affected_features"))
def affected_features_newest(s, d):
    changed = series.obs(s, d).where(F.col("is_revision") & (F.col("as_of") <= _times(s, d)[0]))
    return X.affected(table(s, d, "feature_specs"), changed, "feature_id", "input_series")


@query(series.no_nan("""WITH b AS (SELECT ceil(epoch_us(as_of) / 3600000000)::BIGINT h, series_id, max(struct_pack(t := timestamp, k := as_of, v := value)) b FROM observations WHERE as_of IS NOT NULL GROUP BY 1, 2),
st AS (SELECT unnest(range((SELECT min(h) FROM b), (SELECT max(h) FROM b) + 1)) h)
SELECT st.h step, series_id, max(b.b).v AS "value" FROM st JOIN b ON b.h <= st.h GROUP BY 1, 2""", "value"))
def replay_all_steps(s, d):
    """step (whole hours since 1970), series_id, value: what a replay reads at every hour from the first as_of to the last.

    Each version counts from its first step on; the best so far runs along the steps, so rows are never joined with steps.
    """
    o = series.obs(s, d).where("as_of is not null").withColumn("step", F.ceil(micros("as_of") / 3_600_000_000).cast("bigint"))
    own = o.groupBy("series_id", "step").agg(F.max(F.struct("timestamp", "as_of", "value")).alias("b"))
    ends = own.agg(F.min("step").alias("lo"), F.max("step").alias("hi"))
    grid = own.select("series_id").distinct().join(F.broadcast(ends)).select("series_id", F.explode(F.sequence("lo", "hi")).alias("step"))
    run = F.max("b").over(Window.partitionBy("series_id").orderBy("step"))
    r = grid.join(own, ["series_id", "step"], "left").withColumn("b", run).where("b is not null")
    return r.select("step", "series_id", B.safe(F.col("b.value")).alias("value"))
