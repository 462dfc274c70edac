"""Queries of checks, signals and resolutions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vintagraph.functions import text as T
from vintagraph.operators import assess as A
from vintagraph.operators import graph as G
from vintagraph.operators import retrieval as R
from vintagraph.plans import graphs, nlsql, search
from vintagraph.plans.analytics import _QA, qa
from vintagraph.plans.knowledge import rel
from vintagraph.plans.registry import Registry
from vintagraph.plans.series import no_nan
from vintagraph.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql
_RL = "WITH r AS (SELECT DISTINCT ON (relation_id) *, props.domain_conf c, props.evidence_count k FROM relations ORDER BY relation_id)"


@query(_RL + " SELECT relation_id, round(CASE WHEN k >= 5 THEN 0.3 * (1 - c) ELSE 0 END + 0.25 * (1 - c) + 0.25 * CASE WHEN c < 0.4 THEN 0.5 ELSE 0 END + 0.2 * CASE WHEN type = 'affect' THEN 0.8 WHEN type = 'belongs_to' THEN 0.5 ELSE 0 END, 6) drift, round(0.3 * c + 0.3 * CASE WHEN k >= 10 THEN 1.0 WHEN k >= 5 THEN 0.8 WHEN k >= 3 THEN 0.6 ELSE 0.2 END + 0.2 * (1 - c) + 0.2 * least(1.0, k / 90.0), 6) promotion FROM r")
def edge_signals(s, d):
    c, k = F.col("props.domain_conf"), F.col("props.evidence_count")
    tag = F.when(F.col("type") == "affect", "ambiguous").when(F.col("type") == "belongs_to", "weak").otherwise("none")
    return rel(s, d).select("relation_id", F.round(A.drift_signal(1 - c, k, c < 0.4, tag), 6).alias("drift"), F.round(A.promotion_signal(c, k, 1 - c, k), 6).alias("promotion"))


_W = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+'))"
_NU = "list_distinct(regexp_extract_all(coalesce({0}, ''), '[0-9]+(?:,[0-9]{{3}})*(?:\\.[0-9]+)?'))"
_SH = "CASE WHEN len({0}) > 0 THEN len(list_intersect({0}, {1})) / len({0}) ELSE 1 END"
_UN = "list_distinct([CASE u WHEN 'percent' THEN '%' WHEN 'degC' THEN '℃' WHEN 'minutes' THEN '분' WHEN 'hours' THEN '시간' WHEN 'days' THEN '일' ELSE u END FOR u IN regexp_extract_all(coalesce({0}, ''), '[0-9]+(?:,[0-9]{{3}})*(?:\\.[0-9]+)? ?(" + "|".join(sorted(T.UNITS, key=len, reverse=True)) + ")', 1)])"


@query(_QA + ", x AS (SELECT qa_id, " + ", ".join(f"{f.format(c)} {n}{c[0]}" for f, n in ((_W, "w"), (_NU, "n"), (_UN, "u")) for c in ("expected", "generated")) + " FROM q), y AS (SELECT qa_id, " + _SH.format("we", "wg") + " r, " + _SH.format("ne", "ng") + " n, " + _SH.format("ue", "ug") + " u FROM x) SELECT qa_id, round(0.4 * r + 0.6 * (0.5 * n + 0.3 * u + 0.2 * r), 6) correctness FROM y")
def answer_correctness(s, d):
    return A.correctness(qa(s, d)).select("qa_id", F.round("correctness", 6).alias("correctness"))


@query()
def answer_similarity(s, d):
    return A.similarity(qa(s, d), "expected", "generated").select("qa_id", F.round("similarity", 6).alias("similarity"))


@query(search._NG + search._TF + ", h AS (SELECT i.item_id qid, count(k.id) n, coalesce(avg(k.score), 0) m, coalesce(var_pop(k.score), 0) v FROM eval_items i LEFT JOIN tk k ON k.qid = i.item_id GROUP BY 1), x AS (SELECT qid, m, [z FOR z IN [CASE WHEN n < 3 THEN 'few' END, CASE WHEN m < 0.3 THEN 'low' END, CASE WHEN v < 0.01 THEN 'flat' END] IF z IS NOT NULL] z FROM h) SELECT qid, array_to_string(z, ',') issues, m >= 0.7 AND len(z) = 0 accurate FROM x")
def result_issues(s, d):
    r = A.result_issues(search.tf_top(s, d), search.questions(s, d))
    return r.select("qid", F.array_join("issues", ",").alias("issues"), "accurate")


_DB = "[replace(x, ',', '')::DOUBLE FOR x IN regexp_extract_all({0}, '[0-9]+(?:,[0-9]{{3}})*(?:\\.[0-9]+)?')]"


@query(search._NG + search._TF + ", h AS (SELECT k.qid, k.id, " + _DB.format("i.text") + " q, " + _DB.format("d.text") + " t FROM tk k JOIN eval_items i ON i.item_id = k.qid JOIN documents d ON d.doc_id = k.id), m AS (SELECT qid, id, list_min(flatten([[abs(x - y) FOR y IN t] FOR x IN q])) d FROM h) SELECT qid, id, round(CASE WHEN d = 0 THEN 0.2 WHEN d <= 100 THEN 0.15 / (1 + d) ELSE 0 END, 6) boost FROM m")
def numeric_boost(s, d):
    return A.numeric_boost(search.with_text(s, d, search.tf_top(s, d))).select("qid", "id", F.round("boost", 6).alias("boost"))


@query("""WITH e AS (SELECT DISTINCT id FROM entities WHERE id IS NOT NULL), r AS (SELECT DISTINCT head_id ref FROM relations WHERE head_id IS NOT NULL),
n AS (SELECT lower(trim(id)) k, min(id) v FROM e GROUP BY 1), b AS (SELECT regexp_replace(lower(trim(id)), '[^\\p{L}\\p{N}]', '', 'g') k, min(id) v FROM e GROUP BY 1)
SELECT ref, coalesce(e.id, n.v, b.v) entity, CASE WHEN e.id IS NOT NULL THEN 0.95 WHEN n.v IS NOT NULL THEN 0.9 WHEN b.v IS NOT NULL THEN 0.85 ELSE 0.5 END confidence
FROM r LEFT JOIN e ON e.id = ref LEFT JOIN n ON n.k = lower(trim(ref)) LEFT JOIN b ON b.k = regexp_replace(lower(trim(ref)), '[^\\p{L}\\p{N}]', '', 'g')""")
def entity_resolution(s, d):
    return A.resolve(table(s, d, "relations").select(F.col("head_id").alias("ref")), table(s, d, "entities"))


@query(no_nan("""WITH t AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 01:00:00', TIMESTAMP '2024-01-01 12:00:00', INTERVAL 1 HOUR)) step)
SELECT step, series_id, b.v AS "value" FROM (SELECT step, series_id, max(struct_pack(t := timestamp, k := as_of, v := value)) b FROM t JOIN observations ON as_of <= step GROUP BY 1, 2)""", "value"))
def replay_steps(s, d):
    t = s.range(12).select(F.expr("timestamp_ntz'2024-01-01 01:00:00' + make_dt_interval(0, int(id), 0, 0)").alias("step"))
    return A.replay(table(s, d, "observations"), t)


@query(graphs._FLOW + """, w AS (SELECT src a, dst b, [src, dst] AS path, sign, 1 n FROM e
UNION ALL SELECT a, e.dst, list_append(path, e.dst), w.sign * e.sign, n + 1 FROM w JOIN e ON e.src = w.b WHERE n < 3 AND NOT list_contains(path, e.dst)),
p AS (SELECT a, b, count(*) n, count(*) FILTER (w.sign <> e.sign) bad FROM w JOIN e ON e.src = a AND e.dst = b WHERE n > 1 GROUP BY 1, 2)
SELECT a src, b dst, n n_paths, bad n_contrary FROM p""")
def path_consistency(s, d):
    f = graphs.flows(s, d)
    p = G.simple_paths(f, f.select("src", "dst"), 3).where("n > 1").select("src", "dst", F.col("sign").alias("ps"))
    j = p.join(f.select("src", "dst", "sign"), ["src", "dst"])
    return j.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_paths"), F.count_if(F.col("ps") != F.col("sign")).alias("n_contrary"))


@query(graphs._PATHS + f", k AS (SELECT a, b, array_to_string(path, '>') p, n, strength FROM w JOIN {graphs._ENDS} z ON z.src = a AND z.dst = b) SELECT a src, b dst, p AS path, round(0.5 + 0.8 * strength + 0.3 * 0.5 - 0.1 * n, 6) score FROM k".replace(", k AS", ", kk AS").replace("FROM k", "FROM kk"))
def path_scores(s, d):
    p = G.simple_paths(graphs.flows(s, d), graphs._ends(s, d), 4)
    return p.select("src", "dst", F.array_join("path", ">").alias("path"), F.round(0.5 + 0.8 * F.col("strength") + 0.3 * 0.5 - 0.1 * F.col("n"), 6).alias("score"))


@query(search._BM + search._TF + f", m AS (SELECT qid, id, 0.6 * coalesce({search._MM}, 1) x FROM bk UNION ALL SELECT qid, id, 0.25 * coalesce({search._MM}, 1) FROM tk UNION ALL SELECT qid, id, 0.15 * coalesce({search._MM}, 1) FROM (SELECT qid, id, len(list_intersect(list_distinct(" + search._W.format("i.text") + "), " + search._W.format("d.text") + ")) score FROM bk JOIN documents d ON d.doc_id = id JOIN eval_items i ON i.item_id = qid)) SELECT qid, id, round(sum(x), 6) score FROM m GROUP BY 1, 2")
def multi_view(s, d):
    hits = search.with_text(s, d, search.bm_top(s, d))
    kw = hits.select("qid", "id", F.size(F.array_intersect(T.words("query"), T.words("text"))).cast("double").alias("score"))
    return R.fuse([(search.bm_top(s, d), 0.6), (search.tf_top(s, d), 0.25), (kw, 0.15)]).withColumn("score", F.round("score", 6))


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND length(text) >= 10 AND NOT regexp_matches(lower(text), '생각한다|것으로 본다|as noted above')")
def domain_relevant(s, d):
    opinion = F.exists(F.array(F.lit("생각한다"), F.lit("것으로 본다"), F.lit("as noted above")), lambda w: F.contains(F.lower("text"), w))
    return search.docs(s, d).where((F.length("text") >= 10) & ~opinion).select(F.col("id").alias("doc_id"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+\\.?[0-9]*%p?')) n_quantities, len(regexp_extract_all(text, '(?:^|[^A-Za-z])[A-Z]{2,5}(?:[^A-Za-z]|$)')) n_instruments FROM documents WHERE text IS NOT NULL")
def rule_entities(s, d):
    n = lambda p: F.regexp_count("text", F.lit(p))
    return search.docs(s, d).select(F.col("id").alias("doc_id"), n(r"[0-9]+\.?[0-9]*%p?").alias("n_quantities"), n(r"(?:^|[^A-Za-z])[A-Z]{2,5}(?:[^A-Za-z]|$)").alias("n_instruments"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'rule') AND (timestamp IS NULL OR timestamp >= DATE '2022-01-01') AND regexp_matches(lower(text), 'section (1|2|3)[^0-9]')")
def legal_filter(s, d):
    t = F.lower("text")
    x = table(s, d, "documents").where(F.contains(t, F.lit("rule")) & (F.col("timestamp").isNull() | (F.col("timestamp") >= F.lit("2022-01-01").cast("date"))) & t.rlike("section (1|2|3)[^0-9]"))
    return x.select("doc_id")


@query("SELECT o_orderdate::DATE::VARCHAR AS \"day\", count(*) n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-04-01' AND o_orderdate < TIMESTAMP '1996-05-01' GROUP BY 1 ORDER BY 1 LIMIT 10")
def nl_daily(s, d):
    spec = nlsql.parse("how many orders this month", anchor="1996-04-15")
    spec.group = "day"
    return nlsql.run(spec, {"orders": table(s, d, "orders").withColumn("day", F.to_date("o_orderdate").cast("string"))}).orderBy("day").limit(10)


@query("SELECT user_id, event_type, count(*) n, count(*) FILTER (value >= 50) wins, round(avg(value) FILTER (value >= 50), 6) mean_win FROM events GROUP BY 1, 2")
def replay_aggregates(s, d):
    e = table(s, d, "events").groupBy("user_id", "event_type")
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 50).alias("wins"), F.round(F.avg(F.when(F.col("value") >= 50, F.col("value"))), 6).alias("mean_win"))


@query(_RL + " , u AS (SELECT 'domain' src, c * 0.8 x FROM r UNION ALL SELECT 'personal', least(0.8, k / 1000.0) * 0.4 FROM r UNION ALL SELECT 'log', 0.3 FROM events) SELECT src AS \"source\", count(*) n, round(avg(x), 6) confidence FROM u GROUP BY 1")
def training_sources(s, d):
    r = rel(s, d)
    c = r.select(F.lit("domain").alias("source"), (F.col("props.domain_conf") * 0.8).alias("x"))
    p = r.select(F.lit("personal").alias("source"), (F.least(F.lit(0.8), F.col("props.evidence_count") / 1000.0) * 0.4).alias("x"))
    e = table(s, d, "events").select(F.lit("log").alias("source"), F.lit(0.3).alias("x"))
    return c.unionByName(p).unionByName(e).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("confidence"))
