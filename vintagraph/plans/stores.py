"""Queries over evidence, regimes, features by specification, edits of the graph, candidates and samples, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vintagraph.functions import text as T
from vintagraph.operators import bitemporal as B
from vintagraph.operators import features as X
from vintagraph.operators import knowledge as K
from vintagraph.operators import scoring
from vintagraph.operators import stores as S
from vintagraph.plans import series
from vintagraph.plans.analytics import _QA, qa
from vintagraph.plans.graphs import _E, edges
from vintagraph.plans.registry import Registry
from vintagraph.plans.search import _BM, _NG, _TF, bm_top, docs, tf_top
from vintagraph.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql
#: The newest as_of of the feature values less three hours.
_LATE = "(SELECT max(as_of) - INTERVAL 3 HOUR FROM feature_values)"


def _evidence(s, d):
    """Evidence scores: edge_id, timestamp, as_of, total_score, id; one row per id."""
    e = table(s, d, "feature_values").where("feature_value_id is not null")
    kept = e.groupBy("feature_value_id").agg(F.max(F.struct("feature_id", "timestamp", "as_of", "value")).alias("m"))
    return kept.select(F.col("feature_value_id").alias("id"), F.col("m.feature_id").alias("edge_id"), "m.timestamp", "m.as_of", F.col("m.value").alias("total_score"))


_EV = "WITH e AS (SELECT DISTINCT ON (feature_value_id) feature_value_id id, feature_id edge_id, timestamp, as_of, value total_score FROM feature_values WHERE feature_value_id IS NOT NULL ORDER BY 1, 2 DESC, 3 DESC, 4 DESC, value DESC)"


def _late(s, d):
    return F.lit(table(s, d, "feature_values").agg(F.max("as_of").alias("m")).select(F.expr("m - interval 3 hours")).first()[0]).cast("timestamp_ntz")


@query(_EV + f" SELECT DISTINCT ON (edge_id, timestamp) edge_id, timestamp, as_of, total_score FROM e WHERE as_of <= {_LATE} AND timestamp >= {_LATE} - INTERVAL 1 DAY ORDER BY edge_id, timestamp, as_of DESC, total_score DESC NULLS LAST")
def evidence_range(s, d):
    """Scores of every edge over the last day, as known three hours before the newest."""
    at = _late(s, d)
    return B.as_of_read(_evidence(s, d), at, key="edge_id", keep=("total_score",), start=at - F.expr("interval 1 day"))


@query(_EV + f" SELECT DISTINCT ON (edge_id) edge_id, timestamp, as_of, total_score FROM e WHERE as_of <= {_LATE} ORDER BY edge_id, timestamp DESC, as_of DESC, total_score DESC NULLS LAST")
def evidence_latest(s, d):
    return B.last_value(_evidence(s, d), _late(s, d), key="edge_id", keep=("total_score",))


@query(_EV + " SELECT edge_id, count(*) n, count(DISTINCT timestamp) n_times, min(total_score) least, max(total_score) most, min(timestamp) AS \"first\", max(timestamp) AS \"last\" FROM e GROUP BY 1")
def evidence_stats(s, d):
    return _evidence(s, d).groupBy("edge_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("timestamp").alias("n_times"), F.min("total_score").alias("least"), F.max("total_score").alias("most"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


@query(_EV + f", o AS (SELECT DISTINCT ON (edge_id, timestamp) * FROM e WHERE as_of <= {_LATE} ORDER BY edge_id, timestamp, as_of DESC, id DESC), n AS (SELECT DISTINCT ON (edge_id, timestamp) * FROM e WHERE as_of > {_LATE} ORDER BY edge_id, timestamp, as_of DESC, id DESC) SELECT edge_id, timestamp, coalesce(n.id, o.id) id FROM o FULL JOIN n USING (edge_id, timestamp)")
def evidence_save(s, d):
    """Scores that come later replace those of the same edge and time."""
    e, at = _evidence(s, d), _late(s, d)
    old, new = (B.newest(e.where(c), ["edge_id", "timestamp"], ["as_of", "id"], []).select("edge_id", "timestamp", "id") for c in (F.col("as_of") <= at, F.col("as_of") > at))
    return B.upsert(old, new, ["edge_id", "timestamp"])


_ST = "WITH s AS (SELECT event_id, user_id, ts, CASE WHEN value IS NULL THEN NULL WHEN value >= 75 THEN 'stress' WHEN value >= 40 THEN 'growth' ELSE 'calm' END regime FROM events)"


def _states(s, d):
    regime = F.when(F.col("value") >= 75, "stress").when(F.col("value") >= 40, "growth").when(F.col("value").isNotNull(), "calm")
    return table(s, d, "events").select("event_id", "user_id", "ts", regime.alias("regime"))


@query(_ST + " SELECT event_id, ts FROM s WHERE regime = 'stress'")
def regime_by_name(s, d):
    return _states(s, d).where("regime = 'stress'").select("event_id", "ts")


@query(_ST + ", m AS (SELECT max(ts) - INTERVAL 7 DAY t FROM s) SELECT event_id, ts, regime FROM s, m WHERE ts BETWEEN t AND t + INTERVAL 5 DAY")
def regime_range(s, d):
    """States of the week before the newest, less its last two days."""
    st = _states(s, d)
    t = F.lit(st.agg(F.max("ts").alias("m")).select(F.expr("m - interval 7 days")).first()[0]).cast("timestamp_ntz")
    return st.where(F.col("ts").between(t, t + F.expr("interval 5 days"))).select("event_id", "ts", "regime")


@query(_ST + ", m AS (SELECT max(ts) - INTERVAL 7 DAY t FROM s) SELECT DISTINCT ON (user_id) user_id, ts, event_id, regime FROM s, m WHERE ts <= t ORDER BY user_id, ts DESC, event_id DESC")
def regime_at(s, d):
    """The regime of every user a week before the newest event."""
    st = _states(s, d)
    t = F.lit(st.agg(F.max("ts").alias("m")).select(F.expr("m - interval 7 days")).first()[0]).cast("timestamp_ntz")
    return S.state_at(st, t, "ts", ["event_id", "regime"], "user_id")


@query(_ST + " SELECT regime, count(*) n, min(ts) AS \"first\", max(ts) AS \"last\" FROM s WHERE regime IS NOT NULL GROUP BY 1")
def regime_stats(s, d):
    return S.state_stats(_states(s, d), "ts", "regime")


_FB = series._PTS + """, sp AS (SELECT DISTINCT feature_id, feature_type k, window_days * 86400000000 w, input_series[1] a, input_series[2] b FROM feature_specs WHERE feature_id IS NOT NULL),
fp AS (SELECT feature_id, k, w, t, p.value v FROM sp JOIN p ON p.series_id = sp.a WHERE k <> 'spread'),
x AS (SELECT c.feature_id, c.k, c.t, any_value(c.v) v, count(*) n, avg(y.v) m, stddev_pop(y.v) sd, count(*) FILTER (y.v <= c.v) le FROM fp c JOIN fp y ON y.feature_id = c.feature_id AND y.t BETWEEN c.t - c.w AND c.t WHERE c.k IN ('zscore', 'percentile') GROUP BY 1, 2, 3),
r AS (SELECT c.feature_id, c.t, c.v, y.v prev FROM (SELECT *, t - w u FROM fp WHERE k = 'roc') c ASOF JOIN (SELECT * FROM fp WHERE k = 'roc') y ON y.feature_id = c.feature_id AND c.u >= y.t)
SELECT feature_id, t, round(v, 6) AS "value" FROM (SELECT feature_id, t, v FROM fp WHERE k = 'raw' UNION ALL SELECT feature_id, t, (v - prev) / prev FROM r WHERE prev <> 0
UNION ALL SELECT feature_id, t, CASE WHEN k = 'percentile' THEN le / n ELSE coalesce((v - m) / nullif(sd, 0), 0) END FROM x WHERE k = 'percentile' OR n >= 2
UNION ALL SELECT feature_id, q.t, q.value - y.value FROM sp JOIN p q ON q.series_id = a JOIN p y ON y.series_id = b AND y.t = q.t WHERE k = 'spread')"""


@query(_FB)
def feature_batch(s, d):
    """Every feature of feature_specs over all readings."""
    f = X.compute(series.points(s, d), table(s, d, "feature_specs"))
    return f.select("feature_id", "t", F.round("value", 6).alias("value"))


@query("""WITH r AS (SELECT head_id, tail_id, type, relation_id, created_at FROM relations WHERE head_id IS NOT NULL AND tail_id IS NOT NULL AND type IS NOT NULL) SELECT DISTINCT ON (head_id, tail_id, type) head_id, tail_id, type, relation_id, created_at FROM r ORDER BY head_id, tail_id, type, created_at DESC NULLS LAST, relation_id % 2 DESC, relation_id DESC""")
def relation_upsert(s, d):
    """Relations of even ids as the store, those of odd ids put in: of each (head, tail, type) the newest stays."""
    r = table(s, d, "relations").select("head_id", "tail_id", "type", "relation_id", "created_at").distinct()
    even = F.col("relation_id") % 2 == 0
    return S.upsert_relations(r.where(even), r.where(~even), ["head_id", "tail_id", "type"], "created_at")


@query(_E + ", g AS (SELECT DISTINCT lower(trim(id)) n FROM entities WHERE deleted_at IS NOT NULL) SELECT src, dst, rel, count(*) n FROM e WHERE src NOT IN (SELECT n FROM g WHERE n IS NOT NULL) AND dst NOT IN (SELECT n FROM g WHERE n IS NOT NULL) GROUP BY 1, 2, 3")
def graph_delete(s, d):
    """The edges left when every entity that was ever deleted goes with its edges."""
    gone = table(s, d, "entities").where("deleted_at is not null").select(F.lower(F.trim("id")).alias("node"))
    return S.delete_nodes(edges(s, d), gone).groupBy("src", "dst", "rel").agg(F.count(F.lit(1)).alias("n"))


@query(_BM + _TF + ", u AS (SELECT qid, id, score, 'bm25' s FROM bk UNION ALL SELECT qid, id, score, 'tfidf' FROM tk) SELECT qid, id, round(max(score), 4) score, array_to_string(list(DISTINCT s ORDER BY s), ',') sources FROM u GROUP BY 1, 2")
def candidate_union(s, d):
    m = S.merge_candidates({"bm25": bm_top(s, d), "tfidf": tf_top(s, d)}, ["qid", "id"], "score")
    return m.select("qid", "id", F.round("score", 4).alias("score"), F.array_join("sources", ",").alias("sources"))


_DOM = "('affect', 'cause', 'regulates')"


@query(_E + f", a AS (SELECT DISTINCT src, dst, rel FROM e WHERE rel IN {_DOM}), b AS (SELECT DISTINCT src, dst, rel FROM e WHERE rel NOT IN {_DOM}) SELECT *, 'first' origin FROM a UNION ALL SELECT *, 'second' FROM b WHERE src NOT IN (SELECT src FROM a GROUP BY 1 HAVING count(*) >= 3)")
def paths_with_fallback(s, d):
    """Edges of the domain, and personal ones for nodes with fewer than three."""
    e = edges(s, d).select("src", "dst", "rel").distinct()
    dom = F.col("rel").isin("affect", "cause", "regulates")
    return S.with_fallback(e.where(dom), e.where(~dom), "src")


_DEC = _QA + ", dc AS (SELECT qa_id trace, CASE WHEN confidence >= 0.7 THEN 'answer' WHEN confidence >= 0.4 THEN 'hedge' ELSE 'ask' END decision FROM q WHERE confidence IS NOT NULL), sm AS (SELECT trace, decision, max(value) / 100 reward FROM dc JOIN events ON event_id = trace WHERE value IS NOT NULL GROUP BY 1, 2)"


def _samples(s, d):
    c = F.col("confidence")
    dc = qa(s, d).where("confidence is not null").select(F.col("qa_id").alias("trace"), F.when(c >= 0.7, "answer").when(c >= 0.4, "hedge").otherwise("ask").alias("decision"))
    return S.samples(dc, table(s, d, "events").select(F.col("event_id").alias("trace"), (F.col("value") / 100).alias("reward")), "trace")


@query(_DEC + " SELECT trace, decision, round(reward, 9) reward FROM sm")
def decision_rewards(s, d):
    return _samples(s, d).withColumn("reward", F.round("reward", 9))


@query(_DEC + " SELECT decision, count(*) n, round(avg(reward), 6) mean FROM sm GROUP BY 1")
def sample_counts(s, d):
    return _samples(s, d).groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("reward"), 6).alias("mean"))


@query(_QA + ", l AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY qa_id DESC) r FROM q) SELECT topic, count(*) n, round(avg(processing_time), 6) AS \"seconds\", round(avg(confidence), 6) confidence FROM l WHERE r <= 100 GROUP BY 1")
def method_comparison(s, d):
    """Time and confidence of each topic over its last hundred answers."""
    r = S.last_by(qa(s, d), "topic", ["qa_id"], 100)
    return r.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("processing_time"), 6).alias("seconds"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query(_E + ", c AS (SELECT rel || CASE sign WHEN 1 THEN '+' WHEN -1 THEN '-' ELSE '0' END pattern, src FROM e) SELECT pattern, count(*) n, count(DISTINCT src) n_heads FROM c WHERE pattern IS NOT NULL GROUP BY 1 ORDER BY n DESC, pattern LIMIT 5")
def pattern_stats(s, d):
    """The five commonest patterns of relation and sign, and how many heads use them."""
    sign = F.when(F.col("sign") == 1, "+").when(F.col("sign") == -1, "-").otherwise("0")
    g = edges(s, d).withColumn("pattern", F.concat("rel", sign)).where("pattern is not null").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("n_heads"))
    return g.orderBy(F.col("n").desc(), "pattern").limit(5)


@query(_E + " SELECT rel, count(*) n, round(avg(weight), 6) confidence, count(*) FILTER (weight < 0.4) n_drift, round(avg((sign <> 0)::INT), 6) signed FROM e GROUP BY 1")
def domain_quality(s, d):
    """Mean confidence, edges that drift (below .4) and share with a sign, per relation."""
    return edges(s, d).groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("weight"), 6).alias("confidence"), F.count_if(F.col("weight") < 0.4).alias("n_drift"), F.round(F.avg((F.col("sign") != 0).cast("int")), 6).alias("signed"))


@query("SELECT series_id, count(*) FILTER (b) n_broken, count(*) n FROM (SELECT series_id, CASE WHEN value IS NULL OR isnan(value) OR original_value IS NULL OR isnan(original_value) THEN false ELSE value > original_value END b FROM observations) GROUP BY 1")
def break_conditions(s, d):
    """Readings per series that break the condition 'above the original value'; a missing one breaks nothing."""
    o = series.obs(s, d).select("series_id", B.safe("value").alias("v"), B.safe("original_value").alias("w"))
    return o.groupBy("series_id").agg(F.count_if(S.break_condition(F.col("v"), F.lit(">"), F.col("w"))).alias("n_broken"), F.count(F.lit(1)).alias("n"))


_TY = "ty AS (SELECT lower(trim(id)) id, max(props.type) AS type FROM entities WHERE trim(id) <> '' GROUP BY 1)"
#: Pairs of types that a relation may join (configuration).
PAIRS = [("policy", "sector", "affect"), ("sector", "asset", "affect"), ("indicator", "sector", "affect"), ("policy", "indicator", "affect"), ("law", "sector", "regulates"), ("law", "plant", "regulates"), ("sensor", "process", "measured_by"), ("process", "sensor", "measured_by"), ("asset", "sector", "belongs_to"), ("process", "plant", "belongs_to"), ("sensor", "plant", "belongs_to")]
_FIT = "(" + ", ".join(f"'{a}|{b}|{c}'" for a, b, c in PAIRS) + ")"
_VP = _E + ", " + _TY + f""", f AS (SELECT e.*, h.type ht, t.type tt, (h.type || '|' || t.type || '|' || rel) IN {_FIT} fits FROM e LEFT JOIN ty h ON h.id = src LEFT JOIN ty t ON t.id = dst),
v AS (SELECT *, CASE WHEN ht IS NULL OR tt IS NULL THEN 'unknown_type' WHEN src = dst THEN 'self_loop' WHEN NOT fits THEN 'type_pair' END error, CASE WHEN sign = 0 THEN 0.0 WHEN (sign = 1) = (weight >= 0.3) THEN 0.9 ELSE 0.0 END sg FROM f),
sc AS (SELECT *, 0.4 * weight + 0.3 * sg + 0.3 * 0.8 score FROM v), ds AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'drop' WHEN score >= 0.55 THEN 'domain' WHEN score >= 0.35 THEN 'personal' ELSE 'drop' END destination FROM sc)"""


def _types(s, d):
    return table(s, d, "entities").where("trim(id) <> ''").groupBy(F.lower(F.trim("id")).alias("id")).agg(F.max("props.type").alias("type"))


def _validated(s, d):
    """Schema, signs, semantics, confidence: each edge with its error, score and destination."""
    f = S.type_pair_errors(edges(s, d), _types(s, d), PAIRS)
    error = F.when(F.col("head_type").isNull() | F.col("tail_type").isNull(), "unknown_type").when(F.col("src") == F.col("dst"), "self_loop").when(~F.col("fits"), "type_pair")
    vote = F.when(F.col("sign") == 1, "+").when(F.col("sign") == -1, "-")
    _, sg = K.sign_votes([vote, F.when(vote.isNotNull(), F.when(F.col("weight") >= 0.3, "+").otherwise("-"))])
    score, to = scoring.confidence_route(F.col("weight"), sg, F.lit(0.8), error.isNotNull())
    return f.select("src", "dst", "rel", "sign", "weight", error.alias("error"), score.alias("score"), to.alias("destination"))


@query(_VP + " SELECT src, dst, rel, error, round(score, 6) score, destination FROM ds")
def validation_pipeline(s, d):
    return _validated(s, d).select("src", "dst", "rel", "error", F.round("score", 6).alias("score"), "destination")


@query(_VP + " SELECT destination, error, count(*) n, round(avg(score), 6) mean FROM ds GROUP BY 1, 2")
def validation_stats(s, d):
    return _validated(s, d).groupBy("destination", "error").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"))


_DP = _VP + ", ru AS (SELECT DISTINCT ON (src, dst) src, dst, sign rs FROM ds WHERE weight >= 0.9 AND sign <> 0 ORDER BY src, dst, weight DESC, rel, sign), dc AS (SELECT ds.*, CASE WHEN rs IS NULL THEN 'create' WHEN sign = 0 OR sign = rs THEN 'strengthen' ELSE 'reject' END decision, sum((sign = 1)::INT) OVER (PARTITION BY src, dst) p, sum((sign = -1)::INT) OVER (PARTITION BY src, dst) n FROM ds LEFT JOIN ru USING (src, dst) WHERE destination <> 'drop')"


def _guarded(s, d):
    v = _validated(s, d)
    strong = v.where("weight >= 0.9 and sign <> 0").groupBy("src", "dst").agg(F.min(F.struct((-F.col("weight")).alias("w"), "rel", "sign")).alias("b")).select("src", "dst", F.col("b.sign").alias("rule_sign"))
    g = K.static_guard(v.where("destination <> 'drop'"), strong)
    signs = v.where("destination <> 'drop'").groupBy("src", "dst").agg(F.count_if(F.col("sign") == 1).alias("p"), F.count_if(F.col("sign") == -1).alias("n"))
    return g.join(signs, ["src", "dst"])


@query(_DP + " SELECT src, dst, rel, decision, p > 0 AND n > 0 conflict, CASE WHEN decision = 'reject' THEN 'personal' WHEN p > 0 AND n > 0 AND weight < 0.4 THEN 'drift' ELSE destination END target FROM dc")
def domain_pipeline(s, d):
    """Validated edges past the static guard: what is done with each, whether its pair is in conflict, and where it goes."""
    clash = (F.col("p") > 0) & (F.col("n") > 0)
    target = F.when(F.col("decision") == "reject", "personal").when(clash & (F.col("weight") < 0.4), "drift").otherwise(F.col("destination"))
    return _guarded(s, d).select("src", "dst", "rel", "decision", clash.alias("conflict"), target.alias("target"))


@query(_DP + ", ps AS (SELECT *, (0.25 * weight + 0.3 * 0.6 + 0.2 * 0.8 + 0.25 * 0.5 + 1) / 2 pcs FROM dc WHERE destination = 'personal' OR decision = 'reject') SELECT src, dst, rel, round(pcs, 6) pcs, CASE WHEN pcs >= 0.7 THEN 'strong' WHEN pcs >= 0.4 THEN 'weak' ELSE 'rejected' END label, decision <> 'reject' AND weight >= 0.6 promote FROM ps")
def personal_pipeline(s, d):
    """What the domain does not take: score, label, and whether it is ripe for promotion."""
    r = _guarded(s, d).where("destination = 'personal' or decision = 'reject'")
    p, label = scoring.pcs(F.col("weight"), F.lit(0.6), F.lit(0.8), F.lit(0.5))
    return r.select("src", "dst", "rel", F.round(p, 6).alias("pcs"), label.alias("label"), ((F.col("decision") != "reject") & (F.col("weight") >= 0.6)).alias("promote"))


@query(_E + ", q AS (SELECT a.src, b.dst, a.src || '>' || a.dst x, a.sign sx, a.weight wx, b.src || '>' || b.dst y, b.sign sy, b.weight wy FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> a.dst AND b.src <> b.dst AND a.src <> b.dst), u AS (SELECT src, dst, x AS edge, wx w FROM q WHERE sx > 0 UNION ALL SELECT src, dst, y, wy FROM q WHERE sy > 0), g AS (SELECT src, dst, min(struct_pack(w := -w, e := edge)) hi, min(struct_pack(w := w, e := edge)) lo FROM u GROUP BY 1, 2) SELECT src, dst, 'strongest' kind, hi.e AS edge, 0.0 - hi.w weight, 0.25::DOUBLE AS \"limit\" FROM g UNION ALL SELECT src, dst, 'weakest', lo.e, lo.w, 0.1 FROM g")
def path_break_conditions(s, d):
    """Of all paths of two relations: the edges on which the conclusion about a pair hangs."""
    e = edges(s, d).where("src <> dst")
    step = lambda a: F.struct(F.concat(F.col(f"{a}.src"), F.lit(">"), F.col(f"{a}.dst")).alias("edge"), F.col(f"{a}.sign").alias("sign"), F.col(f"{a}.weight").alias("weight"))
    p = e.alias("a").join(e.alias("b"), F.col("a.dst") == F.col("b.src")).where("a.src <> b.dst").select("a.src", "b.dst", F.array(step("a"), step("b")).alias("steps"))
    return S.path_breaks(p)


#: Words of rising and falling (configuration).
UP, DOWN = ["증가", "상승", "올랐", "늘었", "rose", "rise", "grew", "stronger", "widened"], ["감소", "하락", "줄고", "낮", "fell", "lower", "falls", "weak"]


def _fragments(s, d):
    f = docs(s, d).select("id", F.posexplode_outer(F.split("text", r"(?<=[.!?。])[ \t\n\r]+|[\n\r]+")).alias("n", "text"))
    return f.where("trim(text) <> ''")


@query()
def extraction_mentions(s, d):
    """Entities named in every fragment (sentence or line) of the documents."""
    e = table(s, d, "entities").select(F.lower(F.trim("id")).alias("entity"), F.col("props.type").alias("type"), F.col("props.name").alias("name")).distinct()
    words = table(s, d, "series_metadata").select(F.lower("series_id").alias("entity"), F.lit("series").alias("type"), "name")
    terms = s.createDataFrame([("term:" + w, "term", w) for w in ("turbidity", "free chlorine", "sludge volume", "specific energy", "수온", "원수 탁도", "응집제 주입률", "해운", "정유", "이차전지", "반도체 장비", "은행", "가온 주가지수", "참빛 심리지수", "두레 환율지수", "이랑 운임지수", "너울 변동성지수", "골목 소매지수", "shipping", "banking", "food processing", "Gaon equity index", "Maru credit spread")], "entity string, type string, name string")
    return S.mentions(_fragments(s, d), e.unionByName(words).unionByName(terms))


@query()
def extraction_pipeline(s, d):
    """Fragments, entities, polarity and pairs: the relations that the documents state, with how many fragments state them."""
    f = _fragments(s, d)
    sign = f.select("id", "n", T.polarity("text", UP, DOWN).alias("sign"))
    return S.pair_mentions(extraction_mentions(s, d), sign.where("sign is not null"))
