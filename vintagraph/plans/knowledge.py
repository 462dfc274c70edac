"""Queries over edges, evidence, stores and texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vintagraph.functions import text as T
from vintagraph.operators import knowledge as K
from vintagraph.operators.blocks import running_sum
from vintagraph.plans.graphs import _E, edges
from vintagraph.plans.registry import Registry
from vintagraph.plans.search import _W, docs
from vintagraph.sources.tables import table, unique

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _n():
    return F.count(F.lit(1))


_R = "WITH r AS (SELECT DISTINCT ON (relation_id) * FROM relations ORDER BY relation_id)"


def rel(s, d):
    return unique(s, d, "relations", "relation_id")


@query(_R + """, v AS (SELECT relation_id, list_filter([CASE WHEN trim(props.sign) IN ('+', '-') THEN trim(props.sign) END, CASE WHEN type = 'affect' THEN '+' END, CASE WHEN props.domain_conf < 0.3 THEN '-' END], lambda x: x IS NOT NULL) a FROM r),
c AS (SELECT relation_id, len([x FOR x IN a IF x = '+']) p, len([x FOR x IN a IF x = '-']) n FROM v) SELECT relation_id, CASE WHEN p > n THEN '+' WHEN n > p THEN '-' END sign, CASE WHEN p = n THEN 0.0 WHEN p = 0 OR n = 0 THEN 0.9 ELSE 0.6 END score FROM c""")
def sign_votes(s, d):
    t = F.trim("props.sign")
    sign, score = K.sign_votes([F.when(t.isin("+", "-"), t), F.when(F.col("type") == "affect", "+"), F.when(F.col("props.domain_conf") < 0.3, "-")])
    return rel(s, d).select("relation_id", sign.alias("sign"), score.alias("score"))


@query("WITH t AS (SELECT doc_id, lower(text) t FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, CASE WHEN contains(t, '가장') OR contains(t, 'weakest') THEN 'exaggeration' WHEN contains(t, '상관') OR contains(t, 'correlation') THEN 'correlation' WHEN contains(t, '추정') OR contains(t, 'about') THEN 'weak' ELSE 'plausible' END tag FROM t) SELECT doc_id, tag, CASE tag WHEN 'plausible' THEN 0.8 WHEN 'weak' THEN 0.5 ELSE 0.3 END conf FROM g")
def semantic_tags(s, d):
    tag, conf = K.semantic_tag(F.col("text"), F.lit("cause"), ["가장", "weakest"], ["상관", "correlation"], ["추정", "about"])
    return docs(s, d).select(F.col("id").alias("doc_id"), tag.alias("tag"), conf.alias("conf"))


@query(_E + ", ru AS (SELECT src, dst, max(sign) rule_sign FROM e WHERE rel = 'affect' AND sign <> 0 GROUP BY 1, 2) SELECT src, dst, sign, CASE WHEN rule_sign IS NULL THEN 'create' WHEN sign = 0 OR sign = rule_sign THEN 'strengthen' ELSE 'reject' END decision FROM e LEFT JOIN ru USING (src, dst)")
def static_guard(s, d):
    e = edges(s, d)
    rules = e.where("rel = 'affect' and sign <> 0").groupBy("src", "dst").agg(F.max("sign").alias("rule_sign"))
    return K.static_guard(e.select("src", "dst", "sign"), rules).select("src", "dst", "sign", "decision")


@query("""WITH r AS (SELECT relation_id id, lower(coalesce(head_id, '')) h, lower(coalesce(tail_id, '')) t, lower(type) y FROM (SELECT DISTINCT ON (relation_id) * FROM relations ORDER BY relation_id)),
sp(ord, name, hh, th, sr) AS (VALUES (1, 'law', 'law', NULL, 'affect'), (2, 'plant', 'plt', 'prc', NULL), (3, 'any', NULL, 'ind', 'belongs_to')),
m AS (SELECT id, name, ord, ((hh IS NOT NULL AND contains(h, hh))::INT + (th IS NOT NULL AND contains(t, th))::INT + (sr IS NOT NULL AND sr = y)::INT) / ((hh IS NOT NULL)::INT + (th IS NOT NULL)::INT + (sr IS NOT NULL)::INT) s FROM r, sp),
b AS (SELECT DISTINCT ON (id) * FROM m WHERE s > 0 ORDER BY id, s DESC, ord) SELECT r.id, name spec, round(s, 6) score FROM r LEFT JOIN b USING (id)""")
def spec_match(s, d):
    specs = s.createDataFrame([(1, "law", ["law"], None, "affect"), (2, "plant", ["plt"], ["prc"], None), (3, "any", None, ["ind"], "belongs_to")], "ord int, name string, head_has array<string>, tail_has array<string>, rel string")
    e = rel(s, d).select(F.col("relation_id").alias("id"), F.col("head_id").alias("head"), F.col("tail_id").alias("tail"), F.col("type").alias("rel"))
    return K.spec_match(e, specs).withColumn("score", F.round("score", 6))


_EN = _E.replace("coalesce(props.domain_conf, 0.0) weight", "coalesce(props.domain_conf, 0.0) weight, coalesce(props.evidence_count, 0) n")


def counted(s, d):
    from vintagraph.operators.references import key_of

    sign = F.when(F.trim("props.sign") == "+", 1).when(F.trim("props.sign") == "-", -1).otherwise(0)
    r = rel(s, d).select(key_of("head_id").alias("src"), key_of("tail_id").alias("dst"), F.col("type").alias("rel"), sign.alias("sign"), F.coalesce("props.domain_conf", F.lit(0.0)).alias("conf"), F.coalesce("props.evidence_count", F.lit(0)).alias("n"))
    return r.where("src is not null and dst is not null")


@query(_EN + ", g AS (SELECT src, split_part(dst, '_', 1) dst, coalesce(sum(n) FILTER (sign = 1), 0)::BIGINT pos_n, coalesce(sum(n) FILTER (sign = -1), 0)::BIGINT neg_n, count(*) FILTER (sign = 1) p, count(*) FILTER (sign = -1) m, min(weight) l FROM e GROUP BY 1, 2) SELECT src, dst, pos_n, neg_n, CASE WHEN greatest(pos_n, neg_n) >= 3 * least(pos_n, neg_n) THEN 'personal' WHEN l < 0.4 THEN 'drift' ELSE 'keep' END AS \"action\" FROM g WHERE p > 0 AND m > 0")
def edge_conflicts(s, d):
    return K.conflicts(counted(s, d).withColumn("dst", F.substring_index("dst", "_", 1)))


@query(_E + ", dm AS (SELECT DISTINCT src, dst, sign FROM (SELECT src, dst, max(sign) sign FROM e WHERE weight >= 0.5 GROUP BY 1, 2)) SELECT e.src, e.dst, e.sign, CASE WHEN dm.sign IS NULL THEN 'missing' WHEN dm.sign = e.sign THEN 'same' ELSE 'opposite' END AS \"case\" FROM e LEFT JOIN dm USING (src, dst) WHERE e.weight < 0.5")
def domain_gap(s, d):
    e = edges(s, d)
    domain = e.where("weight >= 0.5").groupBy("src", "dst").agg(F.max("sign").alias("sign"))
    return K.gap(e.where("weight < 0.5").select("src", "dst", "sign"), domain, ["src", "dst"]).select("src", "dst", "sign", "case")


@query("WITH c AS (SELECT user_id, (event_id % 5)::INT lag, round(avg(value) - 50, 6) score FROM events GROUP BY 1, 2), k AS (SELECT DISTINCT ON (user_id) * FROM c ORDER BY user_id, abs(score) DESC, lag) SELECT user_id, lag, score FROM k")
def best_lag(s, d):
    c = table(s, d, "events").groupBy("user_id", (F.col("event_id") % 5).cast("int").alias("lag")).agg(F.round(F.avg("value") - 50, 6).alias("score"))
    return K.best_lag(c, "user_id", "lag", "score")


@query("WITH x AS (SELECT user_id, value - 50 x FROM events WHERE value IS NOT NULL), g AS (SELECT user_id, sum(CASE WHEN x > 0 THEN x ELSE 0 END) pos, sum(CASE WHEN x < 0 THEN -x ELSE 0 END) neg FROM x GROUP BY 1) SELECT user_id, round(pos, 4) pos, round(neg, 4) neg, CASE WHEN pos > 1.2 * neg THEN '+' WHEN neg > 1.2 * pos THEN '-' ELSE 'mixed' END verdict FROM g")
def impact_verdict(s, d):
    r = K.impact(table(s, d, "events").where("value is not null").select("user_id", (F.col("value") - 50).alias("x")), "user_id", "x")
    return r.withColumn("pos", F.round("pos", 4)).withColumn("neg", F.round("neg", 4))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, value >= 50 p, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) n FROM events WHERE value IS NOT NULL),
f AS (SELECT user_id, event_type, 0::BIGINT n, 0.5::DOUBLE c FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_type, e.n, CASE WHEN p THEN least(0.95, c + 0.05 / sqrt(e.n)) ELSE greatest(0.1, c - 0.08) END FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.n = f.n + 1)
SELECT user_id, event_type, round(c, 6) confidence, n::INT n FROM (SELECT DISTINCT ON (user_id, event_type) * FROM f ORDER BY user_id, event_type, n DESC)""")
def confidence_machine(s, d):
    e = table(s, d, "events").where("value is not null").withColumn("p", F.col("value") >= 50)
    return K.confidence_machine(e, ["user_id", "event_type"], ["ts", "event_id"], "p").withColumn("confidence", F.round("confidence", 6))


@query("SELECT event_id, round(coalesce(least(0.8, 2 * count(*) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / nullif(count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0), 6) consistency FROM events")
def pattern_consistency(s, d):
    return K.consistency(table(s, d, "events"), ["user_id"], "event_type", "event_id").select("event_id", F.round("consistency", 6).alias("consistency"))


@query("WITH q AS (SELECT DISTINCT ON (qa_id) * FROM qa_pairs ORDER BY qa_id), x AS (SELECT confidence c, coalesce(expected = generated, false) g FROM q WHERE confidence IS NOT NULL), t AS (SELECT unnest([0.2, 0.4, 0.6, 0.8]) threshold) SELECT threshold::DOUBLE threshold, round(avg(CASE WHEN c < threshold THEN 0 WHEN g THEN 1 ELSE -1 END), 6) reward FROM x, t GROUP BY 1")
def policy_grid(s, d):
    q = unique(s, d, "qa_pairs", "qa_id").where("confidence is not null").select("confidence", F.coalesce(F.col("expected") == F.col("generated"), F.lit(False)).alias("g"))
    return K.grid_search(q, [0.2, 0.4, 0.6, 0.8], "confidence", "g").withColumn("reward", F.round("reward", 6))


@query("SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06' ORDER BY ts DESC, event_id LIMIT 100")
def event_range(s, d):
    e = table(s, d, "events").where("ts >= timestamp_ntz'2024-01-05' and ts < timestamp_ntz'2024-01-06'")
    return e.select("event_id", "ts", "event_type").orderBy(F.col("ts").desc(), "event_id").limit(100)


@query("WITH v AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) r FROM events) SELECT user_id, count(*) n, round(avg(value), 6) mean, max(value) hi FROM v WHERE r <= 20 GROUP BY 1")
def last_twenty(s, d):
    w = Window.partitionBy("user_id").orderBy(F.col("event_id").desc())
    v = table(s, d, "events").withColumn("r", F.row_number().over(w)).where("r <= 20")
    return v.groupBy("user_id").agg(_n().alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("hi"))


@query("WITH e AS (SELECT *, epoch_us(ts) t, max(epoch_us(ts)) OVER () m FROM events) SELECT event_type, count(*) n, count(*) / 60.0 per_second FROM e WHERE t > m - 3600000000 GROUP BY 1")
def realtime_rate(s, d):
    e = table(s, d, "events")
    m = e.agg((F.max("ts") - F.expr("interval 1 hour")).alias("m"))
    return e.join(F.broadcast(m)).where("ts > m").groupBy("event_type").agg(_n().alias("n")).withColumn("per_second", F.col("n") / 60.0)


@query("SELECT series_id, count(*) n FROM (SELECT unnest(input_series) series_id FROM feature_specs) GROUP BY 1 ORDER BY n DESC, series_id LIMIT 5")
def most_used_series(s, d):
    return table(s, d, "feature_specs").select(F.explode("input_series").alias("series_id")).groupBy("series_id").agg(_n().alias("n")).orderBy(F.col("n").desc(), "series_id").limit(5)


@query("WITH n AS (SELECT doc_id, round(0.4 * len(regexp_extract_all(text, '[|~^`]')) / greatest(1, length(text) / 20.0), 6) x, length(text) l FROM documents WHERE text IS NOT NULL), o AS (SELECT *, sum(l) OVER (ORDER BY x DESC, doc_id) u FROM n WHERE x > 0.02) SELECT doc_id, x noise FROM o WHERE u <= 320000")
def repair_budget(s, d):
    """Noisiest documents first, over the whole corpus, while they fit into one budget of characters."""
    n = docs(s, d).select(F.col("id").alias("doc_id"), F.round(0.4 * F.regexp_count("text", F.lit(r"[|~^`]")) / F.greatest(F.lit(1.0), F.length("text") / 20.0), 6).alias("noise"), F.length("text").alias("l"))
    r = running_sum(n.where("noise > 0.02").withColumn("_o", -F.col("noise")), ["_o", "doc_id"], {"running": "l"})
    return r.where("running <= 320000").select("doc_id", "noise")


@query("WITH w AS (SELECT DISTINCT doc_id, unnest(" + _W.format("text") + ") p FROM documents WHERE text IS NOT NULL), q AS (SELECT DISTINCT unnest(" + _W.format("text") + ") p FROM eval_items) SELECT p phrase, count(*) n_docs, min(doc_id) first_doc FROM w JOIN q USING (p) WHERE length(p) > 3 GROUP BY 1")
def expression_index(s, d):
    q = table(s, d, "eval_items").select(F.explode(T.words("text")).alias("phrase")).where("length(phrase) > 3").distinct()
    w = docs(s, d).select("id", F.explode(F.array_distinct(T.words("text"))).alias("phrase"))
    return w.join(q, "phrase").groupBy("phrase").agg(_n().alias("n_docs"), F.min("id").alias("first_doc"))


_DEF = r"(?:기준을?|limit[^.]{0,40} is|below) ([0-9]+(?:\.[0-9]+)?)"


@query(f"WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_DEF}', 1)) v FROM documents WHERE text IS NOT NULL) SELECT doc_id, v::DOUBLE AS \"value\", count(*) n FROM m GROUP BY 1, 2")
def defined_values(s, d):
    m = docs(s, d).select(F.col("id").alias("doc_id"), F.explode(F.regexp_extract_all("text", F.lit(_DEF), F.lit(1))).alias("v"))
    return m.groupBy("doc_id", F.col("v").cast("double").alias("value")).agg(_n().alias("n"))


@query("WITH x AS (SELECT doc_id, lower(text) t FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, len(regexp_extract_all(t, '여과|filtration|filter')) a, len(regexp_extract_all(t, '응집|coagula|floccul')) b, len(regexp_extract_all(t, '소독|chlorin|disinfect')) c FROM x) SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'general' WHEN a >= b AND a >= c THEN 'filtration' WHEN b >= c THEN 'coagulation' ELSE 'disinfection' END process FROM c")
def process_class(s, d):
    n = lambda p: F.regexp_count(F.lower("text"), F.lit(p))
    x = docs(s, d).select(F.col("id").alias("doc_id"), n("여과|filtration|filter").alias("a"), n("응집|coagula|floccul").alias("b"), n("소독|chlorin|disinfect").alias("c"))
    return x.select("doc_id", F.when(F.greatest("a", "b", "c") == 0, "general").when(F.expr("a >= b and a >= c"), "filtration").when(F.expr("b >= c"), "coagulation").otherwise("disinfection").alias("process"))


@query(r"WITH m AS (SELECT id, unnest(regexp_extract_all(content, '[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)? ?(?:분|시간)')) m FROM text_chunks WHERE content IS NOT NULL), p AS (SELECT id, replace(regexp_extract(m, '[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?'), ',', '')::DOUBLE v, CASE WHEN m LIKE '%시간' THEN 60.0 ELSE 1.0 END f FROM m) SELECT id, count(*) n, round(max(v * f), 4) longest_minutes FROM p GROUP BY 1")
def unit_conversion(s, d):
    c = table(s, d, "text_chunks").select("id", F.explode(F.regexp_extract_all("content", F.lit(rf"{T.NUMBER} ?(?:분|시간)"), F.lit(0))).alias("m"))
    v = T.convert(T.measured_value(F.col("m")), T.measured_unit(F.col("m")), F.lit("분"))
    return c.groupBy("id").agg(_n().alias("n"), F.round(F.max(v), 4).alias("longest_minutes"))


@query("SELECT DISTINCT timestamp FROM observations WHERE series_id = 'FILL_00' INTERSECT SELECT timestamp FROM observations WHERE series_id = 'EQX_02'")
def common_times(s, d):
    o = table(s, d, "observations")
    t = lambda x: o.where(F.col("series_id") == x).select("timestamp")
    return t("FILL_00").intersect(t("EQX_02"))


@query("WITH q AS (SELECT DISTINCT ON (qa_id) * FROM qa_pairs ORDER BY qa_id), w AS (SELECT qa_id, list_distinct(" + _W.format("coalesce(question, '')") + ") w, " + _W.format("coalesce(generated, '')") + " g FROM q) SELECT qa_id, round(CASE WHEN len(w) > 0 THEN len(list_intersect(w, g)) / len(w) ELSE 0 END, 6) alignment, CASE WHEN len(w) > 0 AND len(list_intersect(w, g)) / len(w) >= 0.3 THEN 'aligned' ELSE 'off' END state FROM w")
def answer_alignment(s, d):
    q = unique(s, d, "qa_pairs", "qa_id")
    o = T.overlap(F.array_distinct(T.words("question")), T.words("generated"))
    return q.select("qa_id", F.round(o, 6).alias("alignment"), F.when(o >= 0.3, "aligned").otherwise("off").alias("state"))


@query("WITH q AS (SELECT DISTINCT ON (qa_id) * FROM qa_pairs ORDER BY qa_id) SELECT qa_id, CASE WHEN contains(lower(question), 'inflow') THEN question || ' flow' WHEN contains(question, '탁도') THEN question || ' 혼탁도' ELSE question END expanded FROM q")
def query_expansion(s, d):
    q = unique(s, d, "qa_pairs", "qa_id")
    x = F.when(F.contains(F.lower("question"), F.lit("inflow")), F.concat("question", F.lit(" flow"))).when(F.contains("question", F.lit("탁도")), F.concat("question", F.lit(" 혼탁도"))).otherwise(F.col("question"))
    return q.select("qa_id", x.alias("expanded"))


@query("WITH f AS (SELECT DISTINCT pdf_file_id FROM text_chunks WHERE id % 2 = 0) SELECT pdf_file_id, count(*) n FROM text_chunks WHERE pdf_file_id NOT IN (SELECT pdf_file_id FROM f) GROUP BY 1")
def unprocessed_files(s, d):
    t = table(s, d, "text_chunks")
    return t.join(t.where("id % 2 = 0").select("pdf_file_id").distinct(), "pdf_file_id", "left_anti").groupBy("pdf_file_id").agg(_n().alias("n"))


@query(r"WITH t AS (SELECT doc_id, trim(timestamp::VARCHAR) x FROM documents) SELECT doc_id, CASE WHEN x IS NOT NULL THEN epoch_us(x::TIMESTAMP) ELSE -1 END us FROM t")
def parse_times(s, d):
    from vintagraph.session import micros

    return table(s, d, "documents").select("doc_id", F.coalesce(micros(T.parse_timestamp(F.col("timestamp").cast("string"))), F.lit(-1)).alias("us"))


@query("SELECT DISTINCT observation_id, CASE WHEN value IS NULL THEN 'missing' WHEN lower(trim(quality_flag)) = 'error' THEN 'error' WHEN lower(trim(quality_flag)) = 'estimated' THEN 'estimated' ELSE 'ok' END flag FROM observations")
def quality_flags(s, d):
    f = F.lower(F.trim("quality_flag"))
    flag = T.quality_flag(F.col("value").isNull(), F.coalesce(f == "error", F.lit(False)), F.coalesce(f == "estimated", F.lit(False)))
    return table(s, d, "observations").select("observation_id", flag.alias("flag")).distinct()
