"""Queries over versioned observations, features and pairs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagraph.operators import bitemporal as B
from vintagraph.operators import features as X
from vintagraph.session import micros
from vintagraph.sources.tables import table

#: The as-of time of the fixed-time queries, and an earlier one.
AS_OF, EARLIER = "2024-01-01 06:00:00", "2024-01-01 03:00:00"
_ts = lambda s: F.lit(s).cast("timestamp_ntz")
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def no_nan(sql: str, *columns: str) -> str:
    """``sql`` with NaN as null in the given columns."""
    real = ", ".join(f'CASE WHEN NOT isnan("{c}") THEN "{c}" END AS "{c}"' for c in columns)
    return f"SELECT * REPLACE ({real}) FROM ({sql})"


def obs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "observations")


def points(s: SparkSession, d: str) -> DataFrame:
    """series_id, t, value: the last version of each reading, without null and NaN."""
    v = B.latest(obs(s, d).where("value is not null and not isnan(value)"))
    return v.select("series_id", micros("timestamp").alias("t"), "value")


_PTS = """
WITH v AS (SELECT series_id, timestamp, max(struct_pack(k := as_of, v := value)) b FROM observations
           WHERE value IS NOT NULL AND NOT isnan(value) AND as_of IS NOT NULL GROUP BY 1, 2),
     p AS (SELECT series_id, epoch_us(timestamp) t, b.v "value" FROM v)
"""


@query(no_nan(f"SELECT series_id, timestamp, as_of, value FROM (SELECT DISTINCT ON (series_id, timestamp) * FROM observations WHERE as_of <= TIMESTAMP '{AS_OF}' ORDER BY series_id, timestamp, as_of DESC, value DESC)", "value"))
def asof_latest(s, d):
    return B.as_of_read(obs(s, d), _ts(AS_OF))


@query(no_nan(f"SELECT series_id, timestamp, as_of, value FROM (SELECT DISTINCT ON (series_id) * FROM observations WHERE as_of <= TIMESTAMP '{AS_OF}' ORDER BY series_id, timestamp DESC, as_of DESC, value DESC)", "value"))
def last_value(s, d):
    return B.last_value(obs(s, d), _ts(AS_OF))


@query(no_nan("SELECT series_id, timestamp, as_of, value FROM (SELECT DISTINCT ON (series_id, timestamp) * FROM observations WHERE as_of IS NOT NULL ORDER BY series_id, timestamp, as_of DESC, value DESC)", "value"))
def latest_versions(s, d):
    return B.latest(obs(s, d))


@query(no_nan("SELECT series_id, timestamp, as_of, value, row_number() OVER (PARTITION BY series_id, timestamp ORDER BY as_of)::INT vintage FROM (SELECT series_id, timestamp, as_of, max(value) value FROM observations WHERE as_of IS NOT NULL GROUP BY ALL)", "value"))
def vintage_history(s, d):
    return B.versions(obs(s, d))


@query("SELECT DISTINCT series_id FROM observations")
def list_series(s, d):
    return obs(s, d).select("series_id").distinct()


@query(no_nan(f"SELECT feature_id, timestamp, as_of, value FROM (SELECT DISTINCT ON (feature_id) * FROM feature_values WHERE as_of <= TIMESTAMP '{AS_OF}' ORDER BY feature_id, timestamp DESC, as_of DESC, value DESC)", "value"))
def feature_latest_values(s, d):
    return B.last_value(table(s, d, "feature_values"), _ts(AS_OF), key="feature_id")


@query(no_nan("SELECT feature_id, timestamp, as_of, value FROM (SELECT DISTINCT ON (feature_id, timestamp) * FROM feature_values WHERE as_of IS NOT NULL ORDER BY feature_id, timestamp, as_of DESC, value DESC)", "value"))
def feature_at(s, d):
    return B.latest(table(s, d, "feature_values"), key="feature_id")


@query(f"""WITH st AS (SELECT DISTINCT series_id, timestamp, as_of FROM observations WHERE created_at <= TIMESTAMP '{EARLIER}'),
b AS (SELECT *, row_number() OVER (PARTITION BY series_id, timestamp, as_of ORDER BY created_at, source_id) r FROM observations WHERE created_at > TIMESTAMP '{EARLIER}')
SELECT b.observation_id, b.series_id FROM b WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM st WHERE st.series_id = b.series_id AND st.timestamp = b.timestamp AND st.as_of = b.as_of)""")
def dedup_append(s, d):
    o = obs(s, d)
    keys = ["series_id", "timestamp", "as_of"]
    n = B.append_new(o.where(F.col("created_at") <= _ts(EARLIER)), o.where(F.col("created_at") > _ts(EARLIER)), keys, ["created_at", "source_id"])
    return n.select("observation_id", "series_id")


@query(f"""WITH old AS (SELECT DISTINCT ON (series_id) series_id, source_id, created_at FROM observations WHERE created_at <= TIMESTAMP '{EARLIER}' ORDER BY series_id, created_at, observation_id, source_id),
new AS (SELECT DISTINCT ON (series_id) series_id, source_id, created_at FROM observations WHERE created_at > TIMESTAMP '{EARLIER}' ORDER BY series_id, created_at DESC, observation_id DESC, source_id DESC)
SELECT series_id, coalesce(new.source_id, old.source_id) source_id, coalesce(old.created_at, new.created_at) created_at FROM old FULL JOIN new USING (series_id)""")
def upsert_series(s, d):
    o = obs(s, d).select("series_id", "source_id", "created_at", "observation_id")
    old = o.where(F.col("created_at") <= _ts(EARLIER)).groupBy("series_id").agg(F.min(F.struct("created_at", "observation_id", "source_id")).alias("m")).select("series_id", "m.source_id", "m.created_at")
    new = B.newest(o.where(F.col("created_at") > _ts(EARLIER)), ["series_id"], ["created_at", "observation_id", "source_id"], []).select("series_id", "source_id", "created_at")
    return B.upsert(old, new, ["series_id"], ["created_at"])


@query("SELECT series_id, count(*) n FROM observations WHERE NOT (series_id IN ('FILL_00', 'EQX_02') AND timestamp BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-01-01 05:00:00') GROUP BY 1")
def delete_range(s, d):
    r = B.without_range(obs(s, d), "series_id", ["FILL_00", "EQX_02"], "timestamp", _ts("2024-01-01 01:00:00"), _ts("2024-01-01 05:00:00"))
    return r.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 'delete' ELSE 'put' END op, value FROM events),
l AS (SELECT DISTINCT ON (user_id) * FROM e ORDER BY user_id, event_id DESC) SELECT user_id, value FROM l WHERE op <> 'delete'""")
def journal_replay(s, d):
    e = table(s, d, "events")
    e = e.crossJoin(F.broadcast(e.agg(F.min("event_type").alias("_m")))).withColumn("op", F.when(F.col("event_type") == F.col("_m"), "delete").otherwise("put"))
    return B.op_log_state(e, "user_id", "event_id", "op", ["value"])


@query("""WITH g AS (SELECT event_type, max(ts) last_success, max_by(event_id, ts) "cursor" FROM events WHERE value >= 50 GROUP BY 1)
SELECT e.event_type, max(g.last_success) last_success, max(g."cursor") "cursor", count(*) FILTER (WHERE NOT value >= 50 AND (g.last_success IS NULL OR ts > g.last_success)) failures_since, count(*) n_fetches FROM events e LEFT JOIN g USING (event_type) GROUP BY 1""")
def fetch_states(s, d):
    e = table(s, d, "events").withColumn("ok", F.col("value") >= 50)
    return B.fetch_state(e, ["event_type"], "ts", "ok", "event_id")


@query("SELECT user_id, avg(value) mean, count(value) n FROM events GROUP BY 1")
def session_running_mean(s, d):
    return B.running_mean(table(s, d, "events"), ["user_id"], "value")


@query(f"""WITH o AS (SELECT DISTINCT ON (series_id) series_id, observation_id FROM observations WHERE as_of <= TIMESTAMP '{AS_OF}' ORDER BY series_id, as_of DESC, observation_id DESC),
f AS (SELECT DISTINCT ON (feature_id) feature_id, feature_value_id FROM feature_values WHERE as_of <= TIMESTAMP '{AS_OF}' ORDER BY feature_id, as_of DESC, feature_value_id DESC)
SELECT 'series' component, series_id AS key, '{{"observation_id":"' || observation_id || '"}}' payload FROM o
UNION ALL SELECT 'feature', feature_id, '{{"feature_value_id":"' || feature_value_id || '"}}' FROM f""")
def snapshot_at(s, d):
    return B.snapshot({"series": (obs(s, d), "as_of", ["series_id"], ["observation_id"]), "feature": (table(s, d, "feature_values"), "as_of", ["feature_id"], ["feature_value_id"])}, _ts(AS_OF))


@query("SELECT quality_flag, count(*) FILTER (WHERE timestamp > as_of) n_violations, count(*) n_requests, avg(coalesce(timestamp > as_of, false)::INT) rate FROM observations GROUP BY 1")
def lookahead_violations(s, d):
    return B.violations(obs(s, d), "timestamp", "as_of", "quality_flag")


@query(f"""WITH a AS (SELECT DISTINCT ON (series_id) series_id, CASE WHEN NOT isnan(value) THEN value END AS "value" FROM observations WHERE as_of <= TIMESTAMP '{AS_OF}' ORDER BY series_id, timestamp DESC, as_of DESC, observations.value DESC),
b AS (SELECT DISTINCT ON (series_id) series_id, CASE WHEN NOT isnan(value) THEN value END AS "value" FROM observations WHERE as_of <= TIMESTAMP '{AS_OF}' AND timestamp <= TIMESTAMP '{AS_OF}' ORDER BY series_id, timestamp DESC, as_of DESC, observations.value DESC)
SELECT series_id, a.value live, b.value replay, (a.value IS NOT DISTINCT FROM b.value) same FROM a JOIN b USING (series_id)""")
def live_replay_compare(s, d):
    o = obs(s, d)
    return B.compare_runs(B.last_value(o, _ts(AS_OF)), B.last_value(o, _ts(AS_OF), bound_time=True), "series_id", "value")


@query(f"""WITH t AS (SELECT DISTINCT ON (series_id, timestamp) series_id, timestamp, value v1 FROM observations WHERE as_of <= TIMESTAMP '{EARLIER}' ORDER BY series_id, timestamp, as_of DESC, value DESC),
u AS (SELECT DISTINCT ON (series_id, timestamp) series_id, timestamp, value v2 FROM observations WHERE as_of <= TIMESTAMP '{AS_OF}' ORDER BY series_id, timestamp, as_of DESC, value DESC),
j AS (SELECT *, CASE WHEN v1 <> 0 AND NOT isnan(v1) AND NOT isnan(v2) THEN (v2 - v1) / abs(v1) END pct FROM t JOIN u USING (series_id, timestamp))
SELECT series_id, timestamp, pct, CASE WHEN abs(pct) >= 0.2 THEN 'HIGH' ELSE 'MEDIUM' END severity FROM j WHERE abs(pct) >= 0.1""")
def scalar_deltas(s, d):
    o = obs(s, d)
    old, new = (B.as_of_read(o, _ts(x)).withColumn("value", B.safe("value")) for x in (EARLIER, AS_OF))
    return X.deltas(old, new, ["series_id", "timestamp"], "value")


@query(f"SELECT DISTINCT feature_id FROM (SELECT feature_id, unnest(input_series) series_id FROM feature_specs) JOIN (SELECT DISTINCT series_id FROM observations WHERE is_revision AND as_of <= TIMESTAMP '{AS_OF}') USING (series_id)")
def affected_features(s, d):
    changed = obs(s, d).where(F.col("is_revision") & (F.col("as_of") <= _ts(AS_OF)))
    return X.affected(table(s, d, "feature_specs"), changed, "feature_id", "input_series")


HOUR = 1 / 24
_prev = lambda us: f"(SELECT p.series_id, p.t, p.value, q.value prev FROM p ASOF LEFT JOIN p q ON p.series_id = q.series_id AND p.t - {us} >= q.t)"


def _orders(s, d) -> DataFrame:
    o = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), micros("o_orderdate").alias("t")).agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("value"))
    return o


_ORD = "WITH p AS (SELECT o_orderpriority series_id, epoch_us(o_orderdate) t, sum(o_totalprice::DECIMAL(18,2))::DOUBLE \"value\" FROM orders GROUP BY 1, 2)"


def _roc(days: int) -> str:
    return _ORD + f", b AS {_prev(days * X.DAY)} SELECT series_id, t, value, round((value - prev) / prev, 8) roc FROM b WHERE prev IS NOT NULL AND prev <> 0"


@query(_roc(30))
def feat_mom(s, d):
    return X.change(_orders(s, d), 30).withColumn("roc", F.round("roc", 8))


@query(_roc(365))
def feat_yoy(s, d):
    return X.change(_orders(s, d), 365).withColumn("roc", F.round("roc", 8))


@query(_roc(7))
def feat_roc(s, d):
    return X.change(_orders(s, d), 7).withColumn("roc", F.round("roc", 8))


_W30 = "OVER (PARTITION BY series_id ORDER BY t RANGE BETWEEN 2592000000000 PRECEDING AND CURRENT ROW)"


@query(_ORD + f", w AS (SELECT *, avg(value) {_W30} m, stddev_pop(value) {_W30} sd, count(value) {_W30} n FROM p) SELECT series_id, t, value, round(coalesce((value - m) / nullif(sd, 0), 0), 6) z FROM w WHERE n >= 2")
def feat_zscore(s, d):
    return X.zscore(_orders(s, d), 30).withColumn("z", F.round("z", 6))


@query(_ORD + f", r AS (SELECT *, (value - lag(value) OVER q) / nullif(lag(value) OVER q, 0) ret FROM p WINDOW q AS (PARTITION BY series_id ORDER BY t)), w AS (SELECT *, stddev_pop(ret) {_W30} sd, count(ret) {_W30} n FROM r WHERE ret IS NOT NULL) SELECT series_id, t, value, round(sd * sqrt(252), 6) volatility FROM w WHERE n >= 2")
def feat_volatility(s, d):
    return X.volatility(_orders(s, d), 30).withColumn("volatility", F.round("volatility", 6))


@query(_ORD + f", w AS (SELECT *, list(value) {_W30} l FROM p) SELECT series_id, t, value, round(len([x FOR x IN l IF x <= value]) / len(l), 9) pct FROM w")
def feat_percentile(s, d):
    return X.percentile(_orders(s, d), 30).withColumn("pct", F.round("pct", 9))


def _pairs(s, d) -> DataFrame:
    ids = _orders(s, d).select("series_id").distinct()
    return ids.select(F.col("series_id").alias("a")).join(ids.select(F.col("series_id").alias("b")), F.col("a") < F.col("b")).select(F.concat_ws("~", "a", "b").alias("pair"), "a", "b")


_PAIR = _ORD + ", xy AS (SELECT x.series_id || '~' || y.series_id pair, x.t, x.value x, y.value y FROM p x JOIN p y ON x.t = y.t AND x.series_id < y.series_id)"


@query(_PAIR + " SELECT pair, t, round(x - y, 2) spread FROM xy")
def feat_spread(s, d):
    return X.spread(X.paired(_orders(s, d), _pairs(s, d))).withColumn("spread", F.round("spread", 2))


@query(_PAIR + " SELECT pair, t, round(x / y, 8) ratio FROM xy WHERE y <> 0")
def feat_ratio(s, d):
    return X.ratio(X.paired(_orders(s, d), _pairs(s, d))).withColumn("ratio", F.round("ratio", 8))


@query(_PAIR + f", w AS (SELECT *, count(*) {_W30.replace('series_id', 'pair')} n, covar_pop(x, y) {_W30.replace('series_id', 'pair')} c, stddev_pop(x) {_W30.replace('series_id', 'pair')} sx, stddev_pop(y) {_W30.replace('series_id', 'pair')} sy FROM xy) SELECT pair, t, round(c / (sx * sy), 6) corr FROM w WHERE n >= 3 AND sx > 1e-12 AND sy > 1e-12")
def feat_corr(s, d):
    return X.correlation(X.paired(_orders(s, d), _pairs(s, d)), 30).withColumn("corr", F.round("corr", 6))


@query(_PTS + "SELECT series_id, t, value FROM p")
def feat_raw(s, d):
    return points(s, d)


_W1H = "OVER (PARTITION BY series_id ORDER BY t RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)"


@query(_PTS + f", w AS (SELECT *, sum(value::DECIMAL(28, 6)) {_W1H} m, max(value) {_W1H} hi, count(value) {_W1H} n FROM p) SELECT series_id, t, m::DOUBLE / n mean, hi, n FROM w")
def rolling_hour(s, d):
    """Mean, greatest value and number of readings of the hour before; sums are decimal, so their order plays no part."""
    total = F.col("value").cast("decimal(28,6)")
    r = X.rolling(points(s, d), HOUR, {"total": lambda w: F.sum(total).over(w), "hi": lambda w: F.max("value").over(w), "n": lambda w: F.count("value").over(w)})
    return r.select("series_id", "t", (F.col("total").cast("double") / F.col("n")).alias("mean"), "hi", "n")
