"""Queries over forms of times, values, statements and files, over policies and distinct rows, with their SQL."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from vintagraph.functions import questions as Q
from vintagraph.functions import text as T
from vintagraph.operators import assess as A
from vintagraph.operators import bitemporal as B
from vintagraph.operators import knowledge as K
from vintagraph.operators import metrics, scoring
from vintagraph.plans import nlsql
from vintagraph.plans.analytics import _QA, qa
from vintagraph.plans.graphs import _E, edges
from vintagraph.plans.registry import Registry
from vintagraph.session import checkpoint_dir, micros
from vintagraph.sources import readers
from vintagraph.sources.tables import table, unique

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("""SELECT event_id, CASE event_id % 9 WHEN 0 THEN epoch_us(date_trunc('second', ts)) - 32400000000 WHEN 3 THEN epoch_us(date_trunc('minute', ts)) WHEN 5 THEN epoch_us(ts::DATE::TIMESTAMP) WHEN 6 THEN epoch_us(ts::DATE::TIMESTAMP) WHEN 7 THEN epoch_us(ts::DATE::TIMESTAMP) ELSE epoch_us(date_trunc('second', ts)) END us FROM events WHERE ts IS NOT NULL""")
def parse_time_forms(s, d):
    """Every event's time written in one of nine forms and read back (an offset of nine hours is taken off)."""
    forms = ["yyyy-MM-dd'T'HH:mm:ss'+09:00'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd"]
    e = table(s, d, "events").where("ts is not null").select("event_id", "ts")
    text = F.when(F.col("event_id") % 9 == 8, F.floor(micros("ts") / 1_000_000).cast("string"))
    for i, f in enumerate(forms):
        text = text.when(F.col("event_id") % 9 == i, F.date_format("ts", f))
    return e.select("event_id", micros(T.parse_timestamp(text)).alias("us"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS \"value\" FROM orders")
def parse_values(s, d):
    """Amounts written with thousands, a sign and a currency, read back as numbers."""
    return table(s, d, "orders").select("o_orderkey", T.parse_value(F.concat(F.lit("+"), F.format_number("o_totalprice", 2), F.lit(" won"))).alias("value"))


@query("WITH w AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' Very Positive ' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' WHEN 3 THEN '7.5' WHEN 4 THEN '-0.25' ELSE 'odd' END x FROM events) SELECT event_id, CASE lower(trim(x)) WHEN 'very positive' THEN 0.8 WHEN 'negative' THEN -0.5 WHEN 'neutral' THEN 0.0 WHEN '7.5' THEN 1.0 WHEN '-0.25' THEN -0.25 END::DOUBLE sentiment FROM w")
def sentiments(s, d):
    m = F.col("event_id") % 6
    x = F.when(m == 0, " Very Positive ").when(m == 1, "negative").when(m == 2, "neutral").when(m == 3, "7.5").when(m == 4, "-0.25").otherwise("odd")
    return table(s, d, "events").select("event_id", T.sentiment(x).alias("sentiment"))


@query(_QA + ", r AS (SELECT qa_id, lower(trim(expected)) = lower(trim(generated)) hit, confidence c, processing_time p FROM q WHERE expected IS NOT NULL AND generated IS NOT NULL AND confidence IS NOT NULL) SELECT qa_id, round(hit::INT - 0.5 * CASE WHEN hit THEN 0 ELSE c END - 0.2 * abs(coalesce(p, 0) / 100), 6) reward FROM r")
def answer_rewards(s, d):
    r = qa(s, d).where("expected is not null and generated is not null and confidence is not null")
    hit = F.lower(F.trim("expected")) == F.lower(F.trim("generated"))
    return r.select("qa_id", F.round(scoring.reward(hit, F.col("confidence"), F.coalesce("processing_time", F.lit(0.0)) / 100), 6).alias("reward"))


@query(_QA + ", r AS (SELECT topic, avg((lower(trim(expected)) = lower(trim(generated)))::INT) a, avg(abs(confidence - (lower(trim(expected)) = lower(trim(generated)))::INT)) ce, avg((generated IS NOT NULL)::INT) cov, avg(coalesce(processing_time, 0)) cost, count(*) FILTER (confidence < 0.1) fl FROM q WHERE topic IS NOT NULL GROUP BY 1) SELECT topic, round(0.4 * coalesce(a, 0) + 0.2 * greatest(0, 1 - 2 * coalesce(ce, 0)) + 0.15 * cov + 0.1 * (1 - cost / 50) + 0.15 * (1 - least(1, 0.15 * fl)), 6) score FROM r")
def topic_scorecards(s, d):
    hit = (F.lower(F.trim("expected")) == F.lower(F.trim("generated"))).cast("int")
    g = qa(s, d).where("topic is not null").groupBy("topic").agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("a"), F.coalesce(F.avg(F.abs(F.col("confidence") - hit)), F.lit(0.0)).alias("ce"), F.avg(F.col("generated").isNotNull().cast("int")).alias("cov"), F.avg(F.coalesce("processing_time", F.lit(0.0))).alias("cost"), F.count_if(F.col("confidence") < 0.1).alias("fl"))
    return g.select("topic", F.round(scoring.scorecard(F.col("a"), F.col("ce"), F.col("cov"), F.col("cost"), F.col("fl")), 6).alias("score"))


@query("WITH r AS (SELECT DISTINCT ON (relation_id) relation_id, props.domain_conf c, props.evidence_count k FROM relations ORDER BY relation_id) SELECT relation_id, round(least(0.99, c + 0.02 * (k % 7)), 6) strengthened, round(greatest(0.05, c * pow(0.9, k % 5)), 6) weakened FROM r")
def edge_moves(s, d):
    """Confidence of every relation after some support, and after some contradictions."""
    r = unique(s, d, "relations", "relation_id")
    c, k = F.col("props.domain_conf"), F.col("props.evidence_count")
    return r.select("relation_id", F.round(T.strengthened(c, k % 7), 6).alias("strengthened"), F.round(T.weakened(c, k % 5), 6).alias("weakened"))


_STATEMENTS = ["SELECT a FROM t", "select b from t where c = 1", "DROP TABLE t", "SELECT 1", "SELECT a FROM t; DELETE FROM t", "WITH x AS (SELECT 1) SELECT * FROM x", "SELECT date_trunc('day', ts) FROM t", "SELECT to_date(x) FROM t", "", "UPDATE t SET a = 1", "SELECT updated_at FROM t"]
_VALUES = "(VALUES " + ", ".join("('" + x.replace("'", "''") + "')" for x in _STATEMENTS) + ") v(statement)"


@query(f"SELECT statement, starts_with(upper(trim(statement)), 'SELECT') AND contains(' ' || upper(trim(statement)) || ' ', ' FROM ') AND NOT regexp_matches(upper(statement), '\\b(DELETE|DROP|UPDATE|INSERT|ALTER|CREATE|TRUNCATE)\\b') safe, trim(statement) <> '' AND regexp_matches(lower(statement), '\\b(select|with)\\b') AND NOT regexp_matches(lower(statement), '\\b(date_trunc|to_date|to_timestamp|extract|date_part)\\b') portable FROM {_VALUES}")
def statement_checks(s, d):
    """Statements that are single reads, and those that run on any engine."""
    rows = s.createDataFrame([(x, nlsql.is_safe(x)) for x in _STATEMENTS], "statement string, safe boolean")
    return rows.withColumn("portable", Q.dialect_ok("statement"))


@query("SELECT state, count(*) n FROM (SELECT DISTINCT feature_value_id, CASE WHEN as_of IS NULL THEN 'no_as_of' WHEN timestamp > as_of THEN 'look_ahead' ELSE 'ok' END state FROM feature_values) GROUP BY 1")
def guarded_reads(s, d):
    """What a replay may read: feature values by the verdict of the guard."""
    f = table(s, d, "feature_values").select("feature_value_id", B.allowed("timestamp", "as_of").alias("state")).distinct()
    return f.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def _folder(s, d: str, name: str) -> str:
    return f"{checkpoint_dir(s).rstrip('/')}/{name}-{abs(hash(d))}"


@query("SELECT filename, count(*) n, sum(length(content))::BIGINT n_chars, count(page_number) n_pages FROM text_chunks GROUP BY 1")
def corpus_round_trip(s, d):
    """Chunks written as JSON lines to the shared folder and read back."""
    c = table(s, d, "text_chunks").select(F.col("id").cast("string").alias("doc_id"), "filename", F.col("page_number").alias("page"), F.lit(0).alias("start_offset"), F.length("content").alias("length"), F.col("content").alias("text"), F.lit(None).cast("map<string,string>").alias("extra"))
    path = _folder(s, d, "corpus")
    readers.write_chunks(c, path)
    r = readers.read_chunks(s, path)
    return r.groupBy("filename").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"), F.count("page").alias("n_pages"))


@query("SELECT props.type AS type, count(*) n, count(DISTINCT id) n_ids, count(props.description) n_described FROM entities GROUP BY 1")
def graph_round_trip(s, d):
    """Entities written as JSON and read back as a domain graph."""
    path = _folder(s, d, "entities")
    table(s, d, "entities").select("id", "props").write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    r = s.read.schema(readers.ENTITIES).json(path)
    return r.groupBy(F.col("props.type").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"), F.count("props.description").alias("n_described"))


_TABLES = ["orders", "customer", "part", "supplier", "nation"]


@query("SELECT table_name AS \"table\", column_name AS \"column\", CASE " + " ".join(f"WHEN contains(lower(column_name), '{p}') THEN '{m}'" for p, m in readers.MEANINGS) + " WHEN data_type = 'VARCHAR' THEN 'text' WHEN data_type = 'DOUBLE' THEN 'measure' WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'number' ELSE 'other' END meaning FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in _TABLES) + ")")
def column_meanings(s, d):
    """Tables, columns and what they mean by name and type."""
    rows = [(t, f.name, readers.meaning(f.name, f.dataType.simpleString())) for t in _TABLES for f in table(s, d, t).schema]
    return s.createDataFrame(rows, "`table` string, `column` string, meaning string")


#: Additions to questions (configuration).
MORE = {"inflow": ["flow"], "탁도": ["혼탁도"], "limit": ["threshold", "maximum"], "점검": ["검사"], "deadline": ["due"], "교통량": ["통행량"], "index": ["gauge"]}


@query(_QA + " SELECT qa_id, CASE WHEN question IS NOT NULL THEN concat_ws(' ', question, " + ", ".join(f"CASE WHEN contains(lower(question), '{k}') THEN '{' '.join(v)}' END" for k, v in MORE.items()) + ") END expanded FROM q")
def question_expansion(s, d):
    return qa(s, d).select("qa_id", T.expand("question", MORE).alias("expanded"))


@query("SELECT filename, chunk_id, min(id) id FROM text_chunks WHERE chunk_id IS NOT NULL GROUP BY 1, 2")
def distinct_chunks(s, d):
    """Of each file and chunk id the first row."""
    return table(s, d, "text_chunks").where("chunk_id is not null").groupBy("filename", "chunk_id").agg(F.min("id").alias("id"))


@query("SELECT timestamp, count(DISTINCT series_id) n FROM observations WHERE timestamp IS NOT NULL GROUP BY 1 HAVING count(DISTINCT series_id) >= 2")
def shared_times(s, d):
    """Times at which at least two series have a reading."""
    g = table(s, d, "observations").where("timestamp is not null").groupBy("timestamp").agg(F.count_distinct("series_id").alias("n"))
    return g.where("n >= 2")


@query(_E + ", p AS (SELECT a.src, b.dst, a.dst via, a.weight * b.weight w, a.sign * b.sign sign, row_number() OVER (PARTITION BY a.src ORDER BY round(a.weight * b.weight, 12) DESC, b.dst, a.dst, a.rel, b.rel) r FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst AND a.src <> a.dst AND b.src <> b.dst) SELECT src, r::INT \"rank\", dst, via, round(w, 6) strength, sign FROM p WHERE r <= 3")
def ranked_paths(s, d):
    """The three strongest paths of two relations from every entity."""
    from pyspark.sql import Window

    e = edges(s, d).where("src <> dst")
    a, b = e.alias("a"), e.alias("b")
    p = a.join(b, F.col("a.dst") == F.col("b.src")).where("a.src <> b.dst").select("a.src", "b.dst", F.col("a.dst").alias("via"), (F.col("a.weight") * F.col("b.weight")).alias("w"), (F.col("a.sign") * F.col("b.sign")).alias("sign"), F.col("a.rel").alias("r1"), F.col("b.rel").alias("r2"))
    w = Window.partitionBy("src").orderBy(F.round("w", 12).desc(), "dst", "via", "r1", "r2")
    return p.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("src", "rank", "dst", "via", F.round("w", 6).alias("strength"), "sign")


_DRAW = random.Random(17)
_RANDOM = sorted({round(_DRAW.uniform(0.05, 0.95), 3) for _ in range(20)})


@query(_QA + ", t AS (SELECT DISTINCT unnest([" + ", ".join(map(str, _RANDOM)) + "])::DOUBLE threshold) SELECT threshold, round(avg(CASE WHEN confidence < threshold THEN 0 WHEN expected = generated THEN 1 ELSE -1 END), 6) reward FROM t, q WHERE confidence IS NOT NULL AND expected IS NOT NULL AND generated IS NOT NULL GROUP BY 1")
def policy_random(s, d):
    """Rewards of twenty thresholds drawn at random (a fixed seed)."""
    q = qa(s, d).where("confidence is not null and expected is not null and generated is not null").select("confidence", (F.col("expected") == F.col("generated")).alias("good"))
    return K.grid_search(q, _RANDOM, "confidence", "good").withColumn("reward", F.round("reward", 6))


@query("""WITH RECURSIVE h AS (SELECT strftime(ts, '%Y-%m-%d') step, floor(value / 100 / 0.05 + 1e-9)::INT c, count(*) n, count(*) FILTER (event_type = 'purchase') g FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
s AS (SELECT step, row_number() OVER (ORDER BY step) i FROM (SELECT DISTINCT step FROM h)),
f AS (SELECT 0::BIGINT i, NULL::VARCHAR step, 0 t, 0::BIGINT n, 0::BIGINT r, 10 u UNION ALL SELECT s.i, s.step, f.u, x.n, x.r, CASE WHEN x.r > 0 THEN greatest(4, f.u - 1) WHEN x.r < 0 THEN least(18, f.u + 1) ELSE f.u END
FROM f JOIN s ON s.i = f.i + 1, LATERAL (SELECT coalesce(sum(n), 0)::BIGINT n, coalesce(sum(2 * g - n), 0)::BIGINT r FROM h WHERE h.step = s.step AND h.c >= f.u) x)
SELECT step, t * 0.05 threshold, n, r reward, u * 0.05 AS "next" FROM f WHERE i > 0""")
def replay_policy(s, d):
    """A replay day by day: what is taken at the threshold, what it earns, and the next threshold."""
    e = table(s, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("step"), (F.col("value") / 100).alias("score"), (F.col("event_type") == "purchase").alias("good"))
    return K.rolling_policy(e, "step", "score", "good")


_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) n, min({c})::DOUBLE least, max({c})::DOUBLE most, round(sum({c}::DECIMAL(30, 4))::DOUBLE / count({c}), 4) mean FROM orders" for c in _NUM))
def result_summary(s, d):
    """Count, least, greatest and mean of every numeric column of a result, in one pass."""
    o = table(s, d, "orders")
    cols = [f.name for f in o.schema if f.dataType.typeName() in ("double", "float", "integer", "long")]
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"), F.col(c).cast("decimal(30,4)").alias("z")) for c in cols])
    g = o.select(F.explode_outer(each).alias("v")).select("v.*").groupBy("column").agg(F.count("x").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.sum("z").cast("double").alias("_z"))
    return g.select("column", "n", "least", "most", F.round(F.col("_z") / F.col("n"), 4).alias("mean"))


_MEAS = "regexp_extract_all(coalesce({0}, ''), '" + (T.NUMBER + " ?(?:" + "|".join(sorted(T.UNITS, key=len, reverse=True)) + ")").replace("{", "{{").replace("}", "}}") + "')"


@query(_QA + ", m AS (SELECT qa_id, list_distinct(" + _MEAS.format("expected") + ") e, " + _MEAS.format("generated") + " g, [lower(k) FOR k IN accepted_keywords IF k IS NOT NULL] k, lower(coalesce(generated, '')) t FROM q), p AS (SELECT qa_id, CASE WHEN len(e) > 0 THEN len(list_intersect(e, g)) / len(e) END m, CASE WHEN len(k) > 0 THEN len([x FOR x IN k IF contains(t, x)]) / len(k) END w FROM m) SELECT qa_id, round(0.6 * coalesce(w, 1) + 0.4 * coalesce(m, 1), 6) score FROM p")
def domain_scores(s, d):
    """.6 accepted keywords + .4 measurements of the reference that an answer has; what is not asked for counts as had."""
    r = metrics.keyword_accuracy(qa(s, d))
    e = F.array_distinct(T.measurements("expected"))
    m = F.try_divide(F.size(F.array_intersect(e, T.measurements("generated"))), F.size(e))
    return r.select("qa_id", F.round(0.6 * F.coalesce("keyword_accuracy", F.lit(1.0)) + 0.4 * F.coalesce(m, F.lit(1.0)), 6).alias("score"))


_G3 = "list_distinct(CASE WHEN length({0}) > 3 THEN [substr({0}, i, 3) FOR i IN range(1, length({0}) - 1)] ELSE [{0}] END)"


@query("WITH r AS (SELECT DISTINCT head_id ref FROM relations WHERE length(trim(head_id)) > 0), n AS (SELECT DISTINCT id entity FROM entities WHERE length(trim(id)) > 0), a AS (SELECT ref, " + _G3.format("lower(trim(ref))") + " g FROM r), b AS (SELECT entity, " + _G3.format("lower(trim(entity))") + """ h FROM n),
s AS (SELECT ref, entity, len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))) x FROM a, b) SELECT DISTINCT ON (ref) ref, entity, round(x, 6) similarity FROM s WHERE x >= 0.6 ORDER BY ref, x DESC, entity""")
def similar_entities(s, d):
    """Of every head that relations name, the entity whose id looks most like it."""
    r = table(s, d, "relations").select(F.col("head_id").alias("ref"))
    n = table(s, d, "entities").select(F.col("id").alias("entity"), F.col("id").alias("name"))
    return A.similar_names(r, n).withColumn("similarity", F.round("similarity", 6))


@query("SELECT doc_id FROM documents WHERE (contains(lower(source), 'manual') OR contains(lower(source), 'notes')) AND (timestamp IS NULL OR timestamp >= DATE '2021-01-01') AND regexp_matches(lower(text), '(?:제 ?[0-9]+ ?조)|(?:section [0-9]+)')")
def metadata_filtered(s, d):
    """Manuals and notes since 2021 that name an article or section."""
    x = A.metadata_filter(table(s, d, "documents"), "source", "timestamp", "text", ["manual", "notes"], "2021-01-01", ["제 ?[0-9]+ ?조", "section [0-9]+"])
    return x.select("doc_id")


@query("SELECT user_id, count(*) n_messages, min(ts) AS \"first\", max(ts) AS \"last\", max_by(event_type, event_id) last_type FROM events WHERE user_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 2")
def conversations(s, d):
    """Conversations with how many messages they have, when, and the type of the last."""
    g = table(s, d, "events").where("user_id is not null").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_messages"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.max_by("event_type", "event_id").alias("last_type"))
    return g.where("n_messages >= 2")


@query("""WITH r AS (SELECT DISTINCT ON (relation_id) relation_id, head_id, tail_id, type, props.domain_conf c, props.evidence_count k FROM relations ORDER BY relation_id), u AS (SELECT relation_id, 'domain' "source", c * 0.8 x FROM r UNION ALL SELECT relation_id, 'personal', least(0.8, k / 1000.0) * 0.4 FROM r)
SELECT relation_id, arg_max("source", struct_pack(x := x, s := "source")) "source", round(max(x), 6) confidence FROM u WHERE x IS NOT NULL GROUP BY 1""")
def dataset_rows(s, d):
    """One training row a relation: the source that is surest of it (ties to the later name), and its confidence."""
    r = unique(s, d, "relations", "relation_id")
    own = F.array(F.struct((F.col("props.domain_conf") * 0.8).alias("x"), F.lit("domain").alias("s")), F.struct((F.least(F.lit(0.8), F.col("props.evidence_count") / 1000.0) * 0.4).alias("x"), F.lit("personal").alias("s")))
    best = F.array_max(F.filter(own, lambda v: v["x"].isNotNull()))
    return r.select("relation_id", best.alias("b")).where("b is not null").select("relation_id", F.col("b.s").alias("source"), F.round("b.x", 6).alias("confidence"))
