"""The queries of the general training-data problems (1, 3, 5, 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagraph.operators.grid import regular_grid
from vintagraph.operators.known import match_known, pivot_known, with_payload
from vintagraph.operators.references import orphan_counts, orphans, references
from vintagraph.operators.spikes import implausible
from vintagraph.session import cut, micros
from vintagraph.sources.tables import table


def _feature_events(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "feature_values").where("feature_value_id is not null").select("feature_value_id", "feature_id", micros("timestamp").alias("t"), micros("as_of").alias("k"))
    values = v.groupBy("feature_value_id").agg(F.max(F.struct("feature_id", "t", "k")).alias("_v")).select("feature_value_id", "_v.*")
    specs = table(spark, d, "feature_specs").select("feature_id", F.explode(F.array_distinct("input_series")).alias("series_id")).distinct()
    return values.join(specs, "feature_id").select("feature_value_id", "series_id", "t", "k")


def _history(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "observations").select("series_id", micros("timestamp").alias("t"), micros("as_of").alias("k"), "observation_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    h = _history(spark, d)
    m = match_known(_feature_events(spark, d), h, "feature_value_id", "series_id", "t", "k")
    m = m.where((F.col("known_t") != F.col("final_t")) | (F.col("known_k") != F.col("final_k")))
    return with_payload(m, h, "series_id", "t", "k", "observation_id").select("feature_value_id", F.col("known_payload").alias("observation_id"))


def p1_attributes(spark: SparkSession, d: str) -> DataFrame:
    """One row per feature value with a known input: the version of each input series known then, side by side."""
    h = _history(spark, d)
    m = match_known(_feature_events(spark, d), h, "feature_value_id", "series_id", "t", "k")
    m = pivot_known(with_payload(m, h, "series_id", "t", "k", "observation_id"), "feature_value_id", "series_id")
    return m.select("feature_value_id", F.size("attributes").alias("n_known"), F.array_join(F.array_sort(F.map_values("attributes")), ",").alias("observation_ids"))


def p1_versions(spark: SparkSession, d: str) -> DataFrame:
    """One row per feature value: all its input series, and beside them the version known then, null where none was."""
    h = _history(spark, d)
    m = match_known(_feature_events(spark, d), h, "feature_value_id", "series_id", "t", "k")
    m = with_payload(m, h, "series_id", "t", "k", "observation_id", every=True)
    m = pivot_known(m, "feature_value_id", "series_id", every=True)
    return m.select("feature_value_id", F.map_keys("attributes").alias("series_ids"), F.map_values("attributes").alias("observation_ids"))


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return references(table(spark, d, "relations"), "relation_id", {"head": "head_id", "tail": "tail_id"}, "created_at", "relations")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    o = orphans(_refs(spark, d), table(spark, d, "entities"), "id", "created_at", "deleted_at")
    return o.select(F.col("row_id").alias("relation_id"), "endpoint", "reason")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    refs = cut(_refs(spark, d))
    return orphan_counts(orphans(refs, table(spark, d, "entities"), "id", "created_at", "deleted_at"), refs)


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(table(spark, d, "observations"), table(spark, d, "series_metadata"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).where("n_readings = 0").select("series_id", "period_start")


def p5_grid(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    return g.select("series_id", "period_start", "n_readings", F.round("value", 6).alias("value"), F.round("coverage", 9).alias("coverage"), "status")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible(table(spark, d, "observations"), table(spark, d, "series_metadata"))


QUERIES = {f.__name__: f for f in (p1_found, p1_attributes, p1_versions, p3_found, p3_counts, p5_found, p5_grid, p7_found)}

_P1 = """
WITH ev AS (SELECT DISTINCT v.feature_value_id, v.timestamp t, v.as_of k, s.series_id
            FROM feature_values v JOIN (SELECT DISTINCT feature_id, unnest(input_series) series_id FROM feature_specs) s USING (feature_id)),
     h AS (SELECT series_id, timestamp t, as_of k, max(observation_id) observation_id FROM observations WHERE as_of IS NOT NULL GROUP BY 1, 2, 3),
     ba AS (SELECT e.feature_value_id, e.series_id, max(struct_pack(t := h.t, k := h.k, o := h.observation_id)) FILTER (WHERE h.k <= e.k) a,
                   max(struct_pack(t := h.t, k := h.k, o := h.observation_id)) b
            FROM ev e JOIN h ON h.series_id = e.series_id AND h.t <= e.t GROUP BY 1, 2)
"""
_P3 = r"""
WITH r AS (SELECT DISTINCT relation_id, created_at, endpoint, key FROM (
             SELECT relation_id, created_at, unnest(['head', 'tail']) endpoint, unnest([lower(trim(head_id)), lower(trim(tail_id))]) AS key FROM relations)
           WHERE key IS NOT NULL AND key <> ''),
     e AS (SELECT DISTINCT lower(trim(id)) AS key, created_at born, deleted_at died FROM entities),
     o AS (SELECT r.relation_id, r.endpoint, r.created_at, count(e.key) n, coalesce(bool_or(e.died <= r.created_at), false) dead,
                  coalesce(bool_or(e.born <= r.created_at AND (e.died IS NULL OR r.created_at < e.died)), false) live
           FROM r LEFT JOIN e USING (key) GROUP BY 1, 2, 3),
     bad AS (SELECT relation_id, endpoint, created_at, CASE WHEN n = 0 THEN 'missing' WHEN dead THEN 'deleted' ELSE 'late' END reason FROM o WHERE NOT live)
"""
_P5 = """
WITH u AS (SELECT series_id, timestamp, as_of, value FROM observations
           WHERE value IS NOT NULL AND NOT isnan(value) AND lower(trim(coalesce(quality_flag, ''))) <> 'missing'),
     r AS (SELECT series_id, epoch_us(timestamp) t, max_by(value, struct_pack(k := coalesce(as_of, TIMESTAMP '0001-01-01'), v := value)) "value" FROM u GROUP BY 1, 2),
     s AS (SELECT r.*, step_seconds::BIGINT * 1000000 step, floor(t / (step_seconds::BIGINT * 1000000))::BIGINT p FROM r JOIN series_metadata USING (series_id)),
     i AS (SELECT *, lead(t) OVER (PARTITION BY series_id ORDER BY t) nxt FROM s),
     g AS (SELECT series_id, step, unnest(range(min(p), max(p) + 1)) q FROM s GROUP BY 1, 2),
     n AS (SELECT series_id, p q, count(*) n, avg(value) own FROM s GROUP BY 1, 2),
     x AS (SELECT series_id, step, p, t, value, least(coalesce(nxt, t), t + 3 * step) til FROM i),
     c AS (SELECT series_id, step, value, t, til, unnest(range(p, greatest(p, ((til - 1) // step)) + 1)) q FROM x),
     o AS (SELECT series_id, q, sum(greatest(0, least(til, (q + 1) * step) - greatest(t, q * step))::DOUBLE) o,
                  sum(greatest(0, least(til, (q + 1) * step) - greatest(t, q * step))::DOUBLE * value) ov FROM c GROUP BY 1, 2)
"""
SQL = {
    "p1_found": _P1 + "SELECT feature_value_id, a.o observation_id FROM ba WHERE a IS NOT NULL AND (a.t <> b.t OR a.k <> b.k)",
    "p1_attributes": _P1 + "SELECT feature_value_id, count(*)::INT n_known, string_agg(a.o, ',' ORDER BY a.o) observation_ids FROM ba WHERE a IS NOT NULL GROUP BY 1",
    "p1_versions": _P1 + "SELECT feature_value_id, list(ev.series_id ORDER BY ev.series_id) series_ids, list(a.o ORDER BY ev.series_id) observation_ids FROM ev LEFT JOIN ba USING (feature_value_id, series_id) WHERE ev.feature_value_id IS NOT NULL GROUP BY 1",
    "p3_found": _P3 + "SELECT relation_id, endpoint, reason FROM bad",
    "p3_counts": _P3 + ", t AS (SELECT endpoint, strftime(created_at, '%Y-%m') AS month, count(*) n_refs FROM r GROUP BY 1, 2), "
    "b AS (SELECT endpoint, strftime(created_at, '%Y-%m') AS month, reason, count(*) n_orphans FROM bad GROUP BY 1, 2, 3) "
    "SELECT 'relations' AS \"table\", b.endpoint, b.month, b.reason, b.n_orphans, t.n_refs FROM b JOIN t ON t.endpoint = b.endpoint AND t.month IS NOT DISTINCT FROM b.month",
    "p5_found": _P5 + "SELECT g.series_id, g.q * (g.step // 1000000) AS period_start FROM g LEFT JOIN n USING (series_id, q) WHERE n.n IS NULL",
    "p5_grid": _P5 + """SELECT g.series_id, g.q * (g.step // 1000000) AS period_start, coalesce(n.n, 0) n_readings,
       round(CASE WHEN o.o > 0 THEN o.ov / o.o ELSE n.own END, 6) "value", round(least(1.0, coalesce(o.o, 0) / g.step), 9) coverage,
       CASE WHEN n.n > 0 THEN 'observed' WHEN o.o > 0 THEN 'filled' ELSE 'gap' END status
FROM g LEFT JOIN n USING (series_id, q) LEFT JOIN o USING (series_id, q)""",
}
