"""Aggregations, logs, scores, folds, metrics and question-to-query forms, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vintagraph.operators import folds, metrics, scoring
from vintagraph.plans import nlsql
from vintagraph.plans.registry import Registry
from vintagraph.plans.search import vec_top
from vintagraph.session import micros
from vintagraph.sources.tables import table, unique

query = Registry()
QUERIES, SQL = query.queries, query.sql
def _n():
    return F.count(F.lit(1))



@query("SELECT count(*) n, count(DISTINCT series_id) n_series, count(*) FILTER (is_revision) n_revisions, min(timestamp) lo, max(timestamp) hi FROM observations")
def store_stats(s, d):
    return table(s, d, "observations").agg(_n().alias("n"), F.count_distinct("series_id").alias("n_series"), F.count_if("is_revision").alias("n_revisions"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))


@query("SELECT feature_id, count(*) n FROM feature_values GROUP BY 1 ORDER BY n DESC, feature_id LIMIT 10")
def top_features(s, d):
    return table(s, d, "feature_values").groupBy("feature_id").agg(_n().alias("n")).orderBy(F.col("n").desc(), "feature_id").limit(10)


@query("SELECT ts::DATE::VARCHAR AS \"day\", hour(ts)::INT AS \"hour\", event_type, round(sum(value), 4) total, round(avg(value), 6) mean, max(value) hi, min(value) lo, count(*) n FROM events GROUP BY 1, 2, 3")
def hourly_rollup(s, d):
    e = table(s, d, "events").groupBy(F.to_date("ts").cast("string").alias("day"), F.hour("ts").alias("hour"), "event_type")
    return e.agg(F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("hi"), F.min("value").alias("lo"), _n().alias("n"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') n_open, count(*) FILTER (o_orderstatus = 'F') n_done, count(*) FILTER (o_orderstatus = 'P') n_part, count(DISTINCT o_custkey) n_customers, min(o_orderdate) first_at, max(o_orderdate) last_at FROM orders GROUP BY 1")
def status_pivot(s, d):
    is_ = lambda x: F.count_if(F.col("o_orderstatus") == x)
    return table(s, d, "orders").groupBy("o_orderpriority").agg(is_("O").alias("n_open"), is_("F").alias("n_done"), is_("P").alias("n_part"), F.count_distinct("o_custkey").alias("n_customers"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) kinds FROM events GROUP BY 1")
def listagg_types(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("SELECT c_custkey, count(o_orderkey) n_orders, coalesce(round(sum(o_totalprice), 2), 0) total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def customer_left_stats(s, d):
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(_n().alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    j = table(s, d, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return j.select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query("SELECT o_orderkey, c_name, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(c_name, '7') ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def fact_lookup(s, d):
    c = table(s, d, "customer").where(F.contains("c_name", F.lit("7"))).select("c_custkey", "c_name")
    return table(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_orderdate").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(50)


@query("SELECT user_id, min(ts) first_at, max(ts) last_at, epoch_us(max(ts)) - epoch_us(min(ts)) elapsed_us, bool_or(value < 5) failed, min_by(event_type, event_id) first_kind, count(*) n FROM events GROUP BY 1")
def session_summary(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), (micros(F.max("ts")) - micros(F.min("ts"))).alias("elapsed_us"), F.bool_or(F.col("value") < 5).alias("failed"), F.min_by("event_type", "event_id").alias("first_kind"), _n().alias("n"))


@query("SELECT event_type, avg((value >= 10)::INT) success_rate, round(avg(value), 6) mean, round(avg(value) FILTER (value >= 10), 6) mean_ok, count(*) / (SELECT count(*) FROM events) share FROM events GROUP BY 1")
def error_report(s, d):
    e = table(s, d, "events")
    all_ = e.agg(_n().alias("_all"))
    g = e.groupBy("event_type").agg(F.avg((F.col("value") >= 10).cast("int")).alias("success_rate"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg(F.when(F.col("value") >= 10, F.col("value"))), 6).alias("mean_ok"), _n().alias("_n"))
    return g.join(F.broadcast(all_)).withColumn("share", F.col("_n") / F.col("_all")).drop("_n", "_all")


@query("SELECT date_trunc('hour', ts) AS \"hour\", count(*) n, avg((value >= 10)::INT) success_rate, round(avg(value), 6) mean FROM events GROUP BY 1")
def hourly_trend(s, d):
    return table(s, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(_n().alias("n"), F.avg((F.col("value") >= 10).cast("int")).alias("success_rate"), F.round(F.avg("value"), 6).alias("mean"))


@query("WITH w AS (SELECT event_id, user_id, count(*) OVER q n, avg(value) OVER q m, avg((value < 10)::INT) OVER q e FROM events WINDOW q AS (PARTITION BY user_id ORDER BY event_id ROWS 9 PRECEDING)) SELECT event_id, user_id, round(m, 6) mean, round(e, 6) error_rate FROM w WHERE n = 10 AND (m > 60 OR e > 0.1)")
def alerts_last10(s, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-9, 0)
    e = table(s, d, "events").select("event_id", "user_id", F.count(F.lit(1)).over(w).alias("n"), F.avg("value").over(w).alias("m"), F.avg((F.col("value") < 10).cast("int")).over(w).alias("e"))
    return e.where("n = 10 and (m > 60 or e > 0.1)").select("event_id", "user_id", F.round("m", 6).alias("mean"), F.round("e", 6).alias("error_rate"))


@query("SELECT topic, lang, count(*) n FROM documents GROUP BY GROUPING SETS ((topic), (lang), ())")
def gold_distribution(s, d):
    t = table(s, d, "documents")
    return t.groupingSets([["topic"], ["lang"], []], "topic", "lang").agg(_n().alias("n"))


_QA = "WITH q AS (SELECT DISTINCT ON (qa_id) * FROM qa_pairs ORDER BY qa_id)"


def qa(s, d):
    return unique(s, d, "qa_pairs", "qa_id")


@query(_QA + " SELECT metric, round(avg(v), 6) mean, min(v) lo, max(v) hi, count(v) n FROM (SELECT unnest(['confidence', 'processing_time']) metric, unnest([confidence, processing_time]) v FROM q) GROUP BY 1")
def evaluation_stats(s, d):
    u = qa(s, d).select(F.expr("stack(2, 'confidence', confidence, 'processing_time', processing_time) as (metric, v)"))
    return u.groupBy("metric").agg(F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"))


@query("SELECT filename, count(*) n_chunks, avg(length(content)) mean_length, max(page_number) pages FROM text_chunks GROUP BY 1")
def chunk_stats(s, d):
    return table(s, d, "text_chunks").groupBy("filename").agg(_n().alias("n_chunks"), F.avg(F.length("content")).alias("mean_length"), F.max("page_number").alias("pages"))


_WQ = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+')"
_MS = "list_sum([least(len([y FOR y IN e IF y = x]), len([y FOR y IN g IF y = x])) FOR x IN list_distinct(list_intersect(e, g))])"


@query(_QA + ", w AS (SELECT qa_id, " + _WQ.format("expected") + " e, " + _WQ.format("generated") + " g FROM q), i AS (SELECT *, coalesce(" + _MS + ", 0) i FROM w), p AS (SELECT qa_id, CASE WHEN len(g) > 0 THEN i / len(g) ELSE 0 END p, CASE WHEN len(e) > 0 THEN i / len(e) ELSE 0 END r FROM i) SELECT qa_id, round(p, 4) AS \"precision\", round(r, 4) recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) f1 FROM p")
def token_f1(s, d):
    m = metrics.token_f1(qa(s, d))
    return m.select("qa_id", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")])


_B2 = "[array_to_string({0}[i:i + 1], ' ') FOR i IN range(1, greatest(len({0}), 1))]"


@query(_QA + ", v AS (SELECT qa_id, " + _WQ.format("expected") + " ew, " + _WQ.format("generated") + " gw FROM q), w AS (SELECT qa_id, " + _B2.format("ew") + " e, " + _B2.format("gw") + " g FROM v) SELECT qa_id, round(CASE WHEN len(g) > 0 THEN coalesce(" + _MS + ", 0) / len(g) ELSE 0 END, 4) bleu FROM w")
def bleu2(s, d):
    return metrics.bleu(qa(s, d), 2).select("qa_id", F.round("bleu", 4).alias("bleu"))


_NX = r"trim(regexp_replace(lower(coalesce({0}, '')), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query(_QA + ", n AS (SELECT qa_id, " + _NX.format("expected") + " e, " + _NX.format("generated") + " g FROM q) SELECT qa_id, e = g AND e <> '' exact, contains(g, e) AND e <> '' AS \"contains\" FROM n")
def exact_match(s, d):
    return metrics.match(qa(s, d)).select("qa_id", "exact", "contains")


@query()
def rouge_l(s, d):
    return metrics.rouge_l(qa(s, d)).select("qa_id", F.round("rouge_l", 4).alias("rouge_l"))


@query()
def faithfulness(s, d):
    return metrics.faithfulness(qa(s, d)).select("qa_id", F.round("faithfulness", 4).alias("faithfulness"))


@query(_QA + r", n AS (SELECT qa_id, list_distinct(regexp_extract_all(coalesce(expected, ''), '[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?')) e, list_distinct(regexp_extract_all(coalesce(generated, ''), '[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?')) g FROM q) SELECT qa_id, round(CASE WHEN len(e) > 0 THEN len(list_intersect(e, g)) / len(e) END, 4) number_recall FROM n")
def numeric_preservation(s, d):
    return metrics.number_recall(qa(s, d)).select("qa_id", F.round("number_recall", 4).alias("number_recall"))


@query(_QA + " SELECT qa_id, round(CASE WHEN len([k FOR k IN accepted_keywords IF k IS NOT NULL]) > 0 THEN len([k FOR k IN accepted_keywords IF k IS NOT NULL AND contains(lower(coalesce(generated, '')), lower(k))]) / len([k FOR k IN accepted_keywords IF k IS NOT NULL]) END, 4) keyword_accuracy FROM q")
def keyword_accuracy(s, d):
    return metrics.keyword_accuracy(qa(s, d)).select("qa_id", F.round("keyword_accuracy", 4).alias("keyword_accuracy"))


_VEC = """WITH v AS (SELECT vec_id id, label, embedding::DOUBLE[] e FROM embeddings), s AS (SELECT a.id qid, b.id, a.label = b.label rel, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) score FROM v a JOIN v b ON a.id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) r FROM s), t AS (SELECT *, sum(rel::INT) OVER (PARTITION BY qid ORDER BY r) h, sum(rel::INT) OVER (PARTITION BY qid) n FROM k WHERE r <= 10)"""


@query(_VEC + ", g AS (SELECT qid, sum(rel::INT / log2(r + 1)) dcg, max(rel::INT / r) mrr, sum(rel::INT) / 10 p, sum(rel::INT * h / r) ap, max(n) n FROM t GROUP BY 1) SELECT qid, round(dcg / list_sum([1 / log2(i + 1) FOR i IN range(1, greatest(n, 1)::BIGINT + 1)]), 6) ndcg, round(mrr, 6) mrr, round(p, 6) AS \"precision\", round(CASE WHEN n > 0 THEN ap / n ELSE 0 END, 6) ap FROM g")
def ndcg_mrr(s, d):
    l = table(s, d, "embeddings").select("vec_id", "label")
    j = vec_top(s, d).join(l.select(F.col("vec_id").alias("qid"), F.col("label").alias("a")), "qid").join(l.select(F.col("vec_id").alias("id"), F.col("label").alias("b")), "id")
    m = metrics.ranking(j.select("qid", "id", "rank", (F.col("a") == F.col("b")).alias("relevant")), 10)
    return m.select("qid", *[F.round(c, 6).alias(c) for c in ("ndcg", "mrr", "precision", "ap")])


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) n FROM events WHERE value IS NOT NULL),
f AS (SELECT user_id, event_id, n, x::DOUBLE s, 0.0::DOUBLE v FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, 0.2 * x + 0.8 * s, 0.2 * abs(x - s) + 0.8 * v FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, event_id, round(s, 6) score, round(v, 6) volatility FROM f""")
def ema_fold(s, d):
    e = table(s, d, "events").withColumn("_us", micros("ts"))
    r = folds.ema(e, "user_id", "_us", "event_id", "value")
    return r.select("user_id", "event_id", F.round("score", 6).alias("score"), F.round("volatility", 6).alias("volatility"))


_REG = [("busy", 3, "n", ">=", 70.0, 0.0), ("busy", 3, "mean", ">", 50.0, 0.0), ("calm", 2, "n", "<", 70.0, 0.0), ("calm", 2, "mean", "between", 40.0, 60.0), ("odd", 1, "top", ">", 99.0, 0.0), ("odd", 1, "absent", ">", 0.0, 0.0)]
_REGV = ", ".join(f"('{a}', {b}, '{c}', '{o}', {lo}, {hi})" for a, b, c, o, lo, hi in _REG)
_REGS = f"""WITH u AS (SELECT user_id entity, count(*)::DOUBLE n, avg(value) mean, max(value) top FROM events GROUP BY 1), v AS (SELECT entity, unnest(['n', 'mean', 'top']) feature, unnest([n, mean, top]) AS "value" FROM u),
sp(regime, priority, feature, op, lo, hi) AS (VALUES {_REGV}),
j AS (SELECT u.entity, regime, priority, v."value" x, coalesce(CASE op WHEN '>' THEN v."value" > lo WHEN '>=' THEN v."value" >= lo WHEN '<' THEN v."value" < lo WHEN 'between' THEN v."value" BETWEEN lo AND hi END, false) ok FROM u, sp LEFT JOIN v ON v.entity = u.entity AND v.feature = sp.feature),
p AS (SELECT entity, regime, priority, avg(ok::INT) prob, avg((x IS NULL)::INT) missing FROM j GROUP BY 1, 2, 3)"""


def _probs(s, d):
    u = table(s, d, "events").groupBy(F.col("user_id").alias("entity")).agg(_n().cast("double").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top"))
    v = u.select("entity", F.expr("stack(3, 'n', n, 'mean', mean, 'top', top) as (feature, value)"))
    return scoring.regimes(v, s.createDataFrame(_REG, "regime string, priority int, feature string, op string, lo double, hi double"))


@query(_REGS + " SELECT entity, regime, priority, round(prob, 6) prob, round(missing, 6) missing FROM p")
def regime_probability(s, d):
    return _probs(s, d).withColumn("prob", F.round("prob", 6)).withColumn("missing", F.round("missing", 6))


@query(_REGS + ", b AS (SELECT entity, max(struct_pack(prob := prob, priority := priority, regime := regime)) b, var_pop(prob) v, count(*) n, avg(missing) m FROM p GROUP BY 1) SELECT entity, CASE WHEN b.prob > 0 THEN b.regime END regime, round(b.prob, 6) prob, round(greatest(0, least(1, CASE WHEN n > 1 THEN 0.3 / (1 + 10 * v) ELSE 0 END + 0.4 * m + 0.3 * (1 - b.prob))), 6) uncertainty FROM b")
def regime_state(s, d):
    return scoring.primary_regime(_probs(s, d)).withColumn("prob", F.round("prob", 6)).withColumn("uncertainty", F.round("uncertainty", 6))


@query("WITH p AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) previous FROM events WHERE value > 50) SELECT user_id, event_id, event_type, previous FROM p WHERE previous <> event_type")
def regime_transition(s, d):
    e = table(s, d, "events").where("value > 50").select("user_id", "event_id", "event_type")
    return folds.transitions(e, "user_id", "event_id", "event_type")


_CT = "CASE WHEN v >= 0.7 THEN 1.0 WHEN v >= 0.3 THEN 0.5 WHEN v >= -0.3 THEN 0.0 WHEN v >= -0.7 THEN -0.5 ELSE -1.0 END"


@query(f"WITH e AS (SELECT event_type, user_id, CASE WHEN event_id % 3 = 0 THEN -(value / 50 - 1) ELSE value / 50 - 1 END v, 1 + event_id % 4 w FROM events) SELECT event_type, user_id, round(sum({_CT} * w) / sum(w), 6) score, count(*) n FROM e WHERE v IS NOT NULL GROUP BY 1, 2")
def contribution_score(s, d):
    e = table(s, d, "events").select("event_type", "user_id", (F.col("value") / 50 - 1).alias("v"), F.when(F.col("event_id") % 3 == 0, "negative").otherwise("positive").alias("dir"), (1 + F.col("event_id") % 4).alias("w"))
    c = e.withColumn("c", scoring.contribution(F.col("v"), F.col("dir"))).where("c is not null")
    return c.groupBy("event_type", "user_id").agg(F.round(F.sum(F.col("c") * F.col("w")) / F.sum("w"), 6).alias("score"), _n().alias("n"))


_RL = "WITH r AS (SELECT DISTINCT ON (relation_id) *, props.domain_conf c, props.evidence_count k, datediff('day', created_at, TIMESTAMP '2026-06-01') dd FROM relations ORDER BY relation_id)"


@query(_RL + " SELECT relation_id, round(c * 0.9 * (1 + least(0.2, 0.02 * k)) * CASE WHEN k > 500 THEN 1.2 ELSE 1 END * greatest(0.1, 0.5 * 0.8 + 0.5), 6) weight, round(CASE WHEN dd >= 30 THEN c * pow(0.98, dd // 30) ELSE c END, 6) decayed, CASE WHEN c < 0.1 THEN 'negligible' WHEN c < 0.25 THEN 'weak' WHEN c < 0.5 THEN 'moderate' WHEN c < 0.75 THEN 'strong' ELSE 'very_strong' END band FROM r")
def edge_weights(s, d):
    r = unique(s, d, "relations", "relation_id")
    c, k = F.col("props.domain_conf"), F.col("props.evidence_count")
    w = scoring.fused_weight(c, F.lit(0.1), F.lit(1.0), k, F.coalesce(k > 500, F.lit(False)), F.lit(0.8))
    days = F.datediff(F.lit("2026-06-01"), F.to_date("created_at"))
    return r.select("relation_id", F.round(w, 6).alias("weight"), F.round(scoring.decayed(c, days), 6).alias("decayed"), scoring.strength_band(c).alias("band"))


@query(_RL + ", p AS (SELECT relation_id, (0.25 * c + 0.3 * 0.6 + 0.2 * 0.8 + 0.25 * least(0.8, k / 1000.0) + 1) / 2 s, 0.4 * c + 0.3 * 0.8 + 0.3 * 0.5 f FROM r) SELECT relation_id, round(s, 6) pcs, CASE WHEN s >= 0.7 THEN 'strong' WHEN s >= 0.4 THEN 'weak' ELSE 'rejected' END label, round(f, 6) score, CASE WHEN f >= 0.55 THEN 'domain' WHEN f >= 0.35 THEN 'personal' ELSE 'drop' END destination FROM p")
def relation_scores(s, d):
    r = unique(s, d, "relations", "relation_id")
    p, label = scoring.pcs(F.col("props.domain_conf"), F.lit(0.6), F.lit(0.8), F.least(F.lit(0.8), F.col("props.evidence_count") / 1000.0))
    f, to = scoring.confidence_route(F.col("props.domain_conf"), F.lit(0.8), F.lit(0.5), F.lit(False))
    return r.select("relation_id", F.round(p, 6).alias("pcs"), label.alias("label"), F.round(f, 6).alias("score"), to.alias("destination"))


@query("""WITH r AS (SELECT DISTINCT ON (relation_id) * FROM relations ORDER BY relation_id) SELECT relation_id, array_to_string([x FOR x IN [CASE WHEN coalesce(trim(head_id) = '', true) THEN 'no_head' END, CASE WHEN coalesce(trim(tail_id) = '', true) THEN 'no_tail' END, CASE WHEN NOT coalesce(type IN ('affect', 'belongs_to'), false) THEN 'unknown_relation' END, CASE WHEN head_id = tail_id THEN 'self_loop' END] IF x IS NOT NULL], ',') errors FROM r""")
def schema_validation(s, d):
    r = unique(s, d, "relations", "relation_id").select("relation_id", F.col("head_id").alias("src"), F.col("tail_id").alias("dst"), F.col("type").alias("rel"))
    return scoring.schema_errors(r, ["affect", "belongs_to"]).select("relation_id", F.array_join("errors", ",").alias("errors"))


@query("WITH c AS (SELECT c_custkey, greatest(0, least(100, 100 * (c_acctbal - 0) / 9000)) x FROM customer) SELECT c_custkey, round(x, 4) score, CASE WHEN x >= 90 THEN 'A+' WHEN x >= 80 THEN 'A' WHEN x >= 70 THEN 'B' WHEN x >= 60 THEN 'C' WHEN x >= 50 THEN 'D' ELSE 'F' END grade FROM c")
def category_grades(s, d):
    x = scoring.piecewise(F.col("c_acctbal"), F.lit(0.0), F.lit(9000.0))
    return table(s, d, "customer").select("c_custkey", F.round(x, 4).alias("score"), scoring.grade(x).alias("grade"))


@query(_QA + ", b AS (SELECT topic, CASE WHEN confidence < 0.4 THEN 'low' WHEN confidence < 0.7 THEN 'mid' ELSE 'high' END bucket, confidence c, (expected = generated)::INT hit FROM q WHERE confidence IS NOT NULL AND expected IS NOT NULL AND generated IS NOT NULL) SELECT topic, bucket, count(*) n, round(avg(hit), 6) accuracy, round(1 - avg(abs(c - hit)), 6) calibration FROM b GROUP BY GROUPING SETS ((topic), (bucket))")
def policy_report(s, d):
    q = qa(s, d).where("confidence is not null and expected is not null and generated is not null")
    b = q.select("topic", F.when(F.col("confidence") < 0.4, "low").when(F.col("confidence") < 0.7, "mid").otherwise("high").alias("bucket"), F.col("confidence").alias("c"), (F.col("expected") == F.col("generated")).cast("int").alias("hit"))
    return b.groupingSets([["topic"], ["bucket"]], "topic", "bucket").agg(_n().alias("n"), F.round(F.avg("hit"), 6).alias("accuracy"), F.round(1 - F.avg(F.abs(F.col("c") - F.col("hit"))), 6).alias("calibration"))


@query("SELECT e.event_id, coalesce(f.event_id, -1) outcome_id FROM events e LEFT JOIN (SELECT user_id, ts::DATE dt, min(event_id) event_id FROM events GROUP BY 1, 2) f ON f.user_id = e.user_id AND f.dt = e.ts::DATE + 7")
def outcome_join(s, d):
    e = table(s, d, "events").select("event_id", "user_id", F.to_date("ts").alias("dt"))
    f = e.groupBy("user_id", F.date_sub("dt", 7).alias("dt")).agg(F.min("event_id").alias("outcome_id"))
    return e.join(f, ["user_id", "dt"], "left").select("event_id", F.coalesce("outcome_id", F.lit(-1)).alias("outcome_id"))


@query("SELECT c_custkey AS id, 'customer_only' side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'orders_only' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def reconcile(s, d):
    a, b = table(s, d, "customer").select(F.col("c_custkey").alias("id")), table(s, d, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return a.join(b, "id", "left_anti").withColumn("side", F.lit("customer_only")).unionByName(b.join(a, "id", "left_anti").withColumn("side", F.lit("orders_only")))


@query("SELECT event_id, CASE month(ts) WHEN 12 THEN 0.8 + 0.2 * day(ts) / 31 ELSE 0.1 END year_end, CASE WHEN month(ts) % 3 = 0 THEN 0.9 ELSE 0.1 END quarter_end FROM events")
def temporal_scores(s, d):
    m = F.month("ts")
    return table(s, d, "events").select("event_id", F.when(m == 12, 0.8 + 0.2 * F.dayofmonth("ts") / 31).otherwise(0.1).alias("year_end"), F.when(m % 3 == 0, 0.9).otherwise(0.1).alias("quarter_end"))


@query("WITH x AS (SELECT event_id, greatest(-1, least(1, value / 50 - 1)) v FROM events) SELECT event_id, v sentiment, round(1 / (1 + exp(-(v / 0.5))), 6) calibrated FROM x")
def sentiment_calibrated(s, d):
    v = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") / 50 - 1))
    return table(s, d, "events").select("event_id", v.alias("sentiment"), F.round(1 / (1 + F.exp(-(v / 0.5))), 6).alias("calibrated"))


@query("SELECT n_name, count(*) n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name LIKE '%1%' GROUP BY 1 ORDER BY n DESC, n_name LIMIT 10")
def nl_ranking(s, d):
    return nlsql.run(nlsql.parse("top 10 nations containing 1 by number of customers"), {"customer": table(s, d, "customer"), "nation": table(s, d, "nation")})


@query("SELECT count(*) n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-04-01'")
def nl_count(s, d):
    return nlsql.run(nlsql.parse("how many orders last month", anchor="1996-04-15"), {"orders": table(s, d, "orders")})


@query("SELECT o_orderpriority, avg(o_totalprice) mean FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1")
def nl_average(s, d):
    r = nlsql.run(nlsql.parse("average price of orders by priority this year", anchor="1996-04-15"), {"orders": table(s, d, "orders")})
    return r
