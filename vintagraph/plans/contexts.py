"""Queries over retrieved contexts, answers, chunks and questions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vintagraph.functions import questions as Q
from vintagraph.functions import text as T
from vintagraph.operators import chunking as C
from vintagraph.operators import contexts as X
from vintagraph.operators import retrieval as R
from vintagraph.plans.analytics import _QA, _VEC, qa
from vintagraph.plans.registry import Registry
from vintagraph.plans.search import _BM, _W, bm_top, docs, with_text
from vintagraph.session import cut
from vintagraph.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql
#: Terms of the domain and of its processes (configuration).
DOMAIN = ["turbidity", "chlorine", "sludge", "inflow", "탁도", "염소", "슬러지", "유량", "수온", "응집"]
PROCESS = ["filtration", "mixing", "flocculation", "chlorination", "dewatering", "여과", "혼화", "응집", "소독", "침전", "송수"]
PATTERNS = ["제 ?[0-9]+ ?조", "section [0-9]+", "[0-9]{4}년"]
_H = _BM + ', h AS (SELECT qid, id, score, "rank", d.text, i.text query, ' + _W.format("d.text") + " dw, list_distinct(" + _W.format("i.text") + ") w FROM bk JOIN documents d ON d.doc_id = id JOIN eval_items i ON i.item_id = qid)"
_UNIT = "(?:" + "|".join(sorted(T.UNITS, key=len, reverse=True)) + ")"
_MEAS = "regexp_extract_all({0}, '" + (T.NUMBER + " ?" + _UNIT).replace("{", "{{").replace("}", "}}") + "')"
_SHARE = "coalesce(len(list_intersect(w, dw)) / nullif(len(w), 0), 0)"
_hits = lambda words, col: " + ".join(f"contains(lower({col}), '{w}')::INT" for w in words)


def _contexts(s, d, k=20):
    return with_text(s, d, bm_top(s, d, k)).select("qid", "id", "score", "rank", "query", "text")


_REL = _H + ", r AS (SELECT *, least(1, " + _SHARE + " + 0.05 * (" + " + ".join(f"regexp_matches(text, '{p}')::INT" for p in PATTERNS) + ") + CASE WHEN len(" + _MEAS.format("text") + ") > 0 THEN 0.1 ELSE 0 END) rel FROM h), a AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rel, 9) DESC, id) pos, CASE WHEN len(" + _W.format("query") + ") <= 3 THEN 2 WHEN len(" + _W.format("query") + ") <= 6 THEN 3 ELSE 5 END most FROM r)"


def _relevant(s, d):
    c = _contexts(s, d)
    return c.withColumn("score", X.relevance(F.col("query"), F.col("text"), PATTERNS))


@query(_REL + " SELECT qid, id, round(rel, 6) score, pos::INT pos FROM a WHERE pos = 1 OR pos <= most")
def filter_adaptive(s, d):
    r = X.keep_best(_relevant(s, d), X.adaptive(F.col("query")))
    return r.select("qid", "id", F.round("score", 6).alias("score"), "pos")


@query(_REL + " SELECT qid, id, round(rel, 6) score, pos::INT pos FROM a WHERE pos = 1 OR rel >= 0.5")
def filter_threshold(s, d):
    r = X.keep_best(_relevant(s, d), 2**31 - 1, 0.5)
    return r.select("qid", "id", F.round("score", 6).alias("score"), "pos")


@query()
def filter_quality(s, d):
    """Contexts of enough relevance that differ from those taken before."""
    return X.select_diverse(_relevant(s, d).where("score >= 0.25"), 5, 0.8, 0.2)


_MX = "coalesce((score - min(score) OVER (PARTITION BY qid)) / nullif(max(score) OVER (PARTITION BY qid) - min(score) OVER (PARTITION BY qid), 0), 1)"


@query(_H + f", m AS (SELECT *, {_MX} base FROM h), x AS (SELECT qid, id, 1 / (1 + exp(-(0.25 * base + 0.3 * ({_hits(DOMAIN, 'text')}) / {len(DOMAIN)} + 0.2 * least(1, ({_hits(PROCESS, 'text')}) / 10) + 0.25 * least(1, len({_MEAS.format('text')}) / 5)))) score FROM m) SELECT qid, id, round(score, 6) score FROM x WHERE score >= 0.6")
def domain_rerank(s, d):
    c = _contexts(s, d)
    base = R.minmax(c.select("qid", "id", "score")).withColumnRenamed("score", "base")
    x = c.join(base, ["qid", "id"]).withColumn("score", X.domain_score(F.col("base"), F.col("text"), DOMAIN, PROCESS))
    return x.where("score >= 0.6").select("qid", "id", F.round("score", 6).alias("score"))


@query(_H + f", m AS (SELECT *, {_MX} base FROM h) SELECT qid, id, round(0.5 * base + 0.2 * {_SHARE} + 0.3 * least(1, ({_hits(PROCESS, 'text')}) / 10), 6) score FROM m")
def context_scores(s, d):
    return _scored(s, d).select("qid", "id", F.round("score", 6).alias("score"))


def _scored(s, d):
    c = _contexts(s, d)
    base = R.minmax(c.select("qid", "id", "score")).withColumnRenamed("score", "base")
    share = T.overlap(F.array_distinct(T.words("query")), T.words("text"))
    return c.join(base, ["qid", "id"]).withColumn("score", 0.5 * F.col("base") + 0.2 * share + 0.3 * F.least(F.lit(1.0), X.found(F.col("text"), PROCESS) / 10))


@query()
def context_select(s, d):
    """Five contexts a question, each the best of score and difference to those before."""
    return X.select_diverse(_scored(s, d), 5)


@query()
def hybrid_search(s, d):
    """Chunks for every hundredth chunk: .4 cosine, .3 shared words, .3 shared measurements; near copies passed over."""
    c = table(s, d, "text_chunks").where("size(embedding) = 64 and content is not null")
    v = cut(c.select("id", F.col("embedding").alias("v")))
    top = R.vector_top(v, v.where("id % 100 = 0").select(F.col("id").alias("qid"), "v"), 20)
    t = c.select("id", F.col("content").alias("text"))
    h = top.join(t, "id").join(t.select(F.col("id").alias("qid"), F.col("text").alias("query")), "qid").where("id <> qid")
    m = T.overlap(T.measurements("query"), T.measurements("text"))
    x = h.withColumn("score", 0.4 * F.col("score") + 0.3 * T.overlap(F.array_distinct(T.words("query")), T.words("text")) + 0.3 * m).where("score >= 0.1")
    return X.select_diverse(x, 10, 1.0, 0.2)


#: Words of guessing and of general talk (configuration).
GUESS, GENERAL = ["아마", "추정", "것 같", "probably", "perhaps", "might", "i think"], ["일반적으로", "보통은", "in general", "generally", "typically"]
_UN = _QA + f""", b AS (SELECT qa_id, coalesce(generated, '') a, coalesce(expected, '') c, coalesce(question, '') qq FROM q),
w AS (SELECT *, list_distinct({_W.format('a')}) aw, list_distinct({_W.format('c')}) cw, list_distinct({_W.format('qq')}) qw, {_MEAS.format('a')} am, {_MEAS.format('c')} cm, [x FOR x IN string_split_regex(regexp_replace(a, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) IF length(trim(x)) > 10] ss FROM b),
g AS (SELECT qa_id, a <> '' AND coalesce(len(list_intersect(aw, cw)) / nullif(len(aw), 0), 0) < 0.3 d, a <> '' AND ({_hits(GENERAL, 'a')}) > 0 ge, a <> '' AND len([x FOR x IN am IF NOT list_contains(cm, x)]) > 0 nu,
a <> '' AND coalesce(len(list_intersect(qw, aw)) / nullif(len(qw), 0), 0) < 0.4 qu, a <> '' AND ({_hits(GUESS, 'a')}) > 0 sp, a <> '' AND len([x FOR x IN ss IF coalesce(len(list_intersect(list_distinct({_W.format('x')}), cw)) / nullif(len(list_distinct({_W.format('x')})), 0), 0) < 0.2]) > 0 se FROM w)
SELECT qa_id, array_to_string([x FOR x IN [CASE WHEN d THEN 'document' END, CASE WHEN ge THEN 'general' END, CASE WHEN nu THEN 'number' END, CASE WHEN qu THEN 'question' END, CASE WHEN se THEN 'sentence' END, CASE WHEN sp THEN 'speculation' END] IF x IS NOT NULL], ',') signs,
round(0.5 * d::INT + 0.8 * ge::INT + 0.9 * nu::INT + 0.4 * qu::INT + 0.7 * se::INT + 0.6 * sp::INT, 6) weight FROM g"""


@query(_UN)
def unsupported_answers(s, d):
    """What speaks against every generated answer, with the reference answer as its context."""
    r = qa(s, d).select("qa_id", "question", F.col("generated").alias("answer"), F.col("expected").alias("context"))
    return X.unsupported(r, GUESS, GENERAL).select("qa_id", F.array_join("signs", ",").alias("signs"), F.round("weight", 6).alias("weight"))


@query(_H + f", z AS (SELECT qid, \"rank\", {_SHARE} sh, list_intersect(w, dw) i, len(w) n FROM h WHERE \"rank\" <= 5), g AS (SELECT qid, avg((sh >= 0.3)::INT) p, len(list_distinct(flatten(list(i)))) / nullif(max(n), 0) c, max(CASE WHEN \"rank\" = 1 THEN (sh >= 0.3)::INT END) f FROM z GROUP BY 1) SELECT qid, round(p, 6) AS \"precision\", round(0.4 * p + 0.4 * coalesce(c, 0) + 0.2 * coalesce(f, 0), 6) overall FROM g")
def context_precision(s, d):
    c = X.context_precision(_contexts(s, d, 5))
    return c.select("qid", F.round("precision", 6).alias("precision"), F.round("overall", 6).alias("overall"))


@query(_VEC + ", n AS (SELECT a.id qid, count(*) n FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id WHERE a.id % 100 = 0 GROUP BY 1), g AS (SELECT qid, count(*) FILTER (rel) h, coalesce(max(1) FILTER (rel AND r <= 1), 0) h1, coalesce(max(1) FILTER (rel AND r <= 3), 0) h3, coalesce(max(1) FILTER (rel AND r <= 5), 0) h5 FROM t GROUP BY 1), m AS (SELECT g.*, coalesce(h / n, 0) rc, h / 10 pr FROM g LEFT JOIN n USING (qid)) SELECT qid, round(rc, 6) recall, round(coalesce(2 * rc * pr / nullif(rc + pr, 0), 0), 6) f1, h1::INT hit1, h3::INT hit3, h5::INT hit5 FROM m")
def ranking_at_k(s, d):
    from vintagraph.plans.search import vec_top

    l = table(s, d, "embeddings").select("vec_id", "label")
    j = vec_top(s, d).join(l.select(F.col("vec_id").alias("qid"), F.col("label").alias("a")), "qid").join(l.select(F.col("vec_id").alias("id"), F.col("label").alias("b")), "id")
    # of a label, all but the asking vector
    n = l.where("vec_id % 100 = 0").join(l.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n")), "label").select(F.col("vec_id").alias("qid"), "n")
    r = X.at_k(j.select("qid", "rank", (F.col("a") == F.col("b")).alias("relevant")), n, 10)
    return r.select("qid", F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"), "hit1", "hit3", "hit5")


_MODE = _H + f", m AS (SELECT *, {_MX} base FROM h)"


@query(_MODE + ' SELECT qid, id, \'accuracy\' AS mode FROM m WHERE "rank" <= 10 AND base >= 0.7 UNION ALL SELECT qid, id, \'exploration\' FROM m WHERE "rank" <= 20 AND base >= 0.2')
def legal_modes(s, d):
    """Accuracy keeps few sure hits, exploration many."""
    c = bm_top(s, d, 20)
    r = c.select("qid", "id", "rank").join(R.minmax(c.select("qid", "id", "score")), ["qid", "id"])
    one = lambda k, least, name: r.where((F.col("rank") <= k) & (F.col("score") >= least)).select("qid", "id", F.lit(name).alias("mode"))
    return one(10, 0.7, "accuracy").unionByName(one(20, 0.2, "exploration"))


_LAW = r"regexp_extract({0}, '([가-힣]+(?: [가-힣]+)* (?:규정|규칙|조례|지침|세칙)|[A-Z][a-z]+(?: [A-Z][a-z]+)+ (?:Rule|Code|Ordinance|Guideline))', 1)"


@query(_QA + f", b AS (SELECT qa_id, nullif({_LAW.format('question')}, '') law FROM q), l AS (SELECT doc_id, nullif({_LAW.format('text')}, '') law FROM documents WHERE text IS NOT NULL), n AS (SELECT law, count(*) n_docs, min(doc_id) example FROM l WHERE law IS NOT NULL GROUP BY 1) SELECT qa_id, law, coalesce(n_docs, 0) n_docs, example FROM b LEFT JOIN n USING (law) WHERE law IS NOT NULL")
def law_inference(s, d):
    """The rule that a question names, and the documents whose first named rule it is."""
    p = r"([가-힣]+(?: [가-힣]+)* (?:규정|규칙|조례|지침|세칙)|[A-Z][a-z]+(?: [A-Z][a-z]+)+ (?:Rule|Code|Ordinance|Guideline))"
    law = lambda c: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    b = qa(s, d).select("qa_id", law("question").alias("law")).where("law is not null")
    n = docs(s, d).select("id", law("text").alias("law")).where("law is not null").groupBy("law").agg(F.count(F.lit(1)).alias("n_docs"), F.min("id").alias("example"))
    return b.join(n, "law", "left").select("qa_id", "law", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "example")


@query()
def document_pipeline(s, d):
    """Search, filter, rerank, selection and the length of the context that would be sent: one row a question."""
    r = X.keep_best(_relevant(s, d), 10, 0.2).drop("pos", "rank")
    r = r.withColumn("score", X.domain_score(F.col("score"), F.col("text"), DOMAIN, PROCESS))
    best = X.select_diverse(r, 3).join(docs(s, d).select("id", "text"), "id")
    return best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "id")))["id"].alias("ids"), F.sum(F.length("text")).alias("n_chars"))


_FX = "f AS (SELECT doc_id id, c::INT chunk, substr(text, c * 500 + 1, 500) text FROM (SELECT doc_id, text, unnest(range((length(text) - 1) // 500 + 1)) c FROM documents WHERE length(text) > 0))"


@query("WITH " + _FX + ", w AS (SELECT *, lag(text) OVER o a, lead(text) OVER o b, array_to_string(regexp_extract_all(text, '" + T.NUMBER + "'), ' ') n FROM f WINDOW o AS (PARTITION BY id ORDER BY chunk)) SELECT id, chunk, md5(concat_ws(' ', right(a, 100), text, left(b, 100), n, n)) h FROM w WHERE n <> ''")
def chunk_numeric(s, d):
    c = C.numeric(C.fixed(docs(s, d)).drop("start"), T.NUMBER)
    return c.select("id", "chunk", F.md5("text").alias("h"))


@query()
def chunk_bounded(s, d):
    return C.chunked(docs(s, d), C.bounded, "bounded").select("id", "chunk", "text")


@query()
def chunk_process(s, d):
    """Chunks at the headings of process sections, long ones by sentences."""
    return C.chunked(docs(s, d), lambda t: C.sections(t, r"^.{0,40}(?:공정|단계|process|stage).{0,40}$"), "process").select("id", "chunk", "text")


@query()
def chunk_articles(s, d):
    return C.chunked(docs(s, d), C.articles, "articles").select("id", "chunk", "text")


_NQ = Q.NO_QUANTITY


@query(f"SELECT doc_id, array_to_string(regexp_extract_all(regexp_replace(text, '{_NQ}', ' ', 'g'), '{T.NUMBER}'), '|') numbers FROM documents WHERE text IS NOT NULL")
def quantity_numbers(s, d):
    """The numbers of every document that are quantities, not dates, times, versions or ids."""
    return docs(s, d).select(F.col("id").alias("doc_id"), F.array_join(Q.quantities("text"), "|").alias("numbers"))


@query(f"SELECT doc_id, unnest(regexp_extract_all(text, '[^\\s]+ {T.NUMBER}(?: ?[~-] ?{T.NUMBER})? ?{_UNIT}')) m FROM documents WHERE text IS NOT NULL")
def measured_ranges(s, d):
    return docs(s, d).select(F.col("id").alias("doc_id"), F.explode(Q.ranges("text", T.UNITS)).alias("m"))


@query("SELECT observation_id, CASE lower(trim(unit)) WHEN 'pct' THEN '%' WHEN 'percent' THEN '%' WHEN 'bp' THEN 'bps' WHEN 'decimal_rate' THEN '%' ELSE trim(unit) END AS unit, max(CASE WHEN NOT isnan(value) THEN value * CASE lower(trim(unit)) WHEN 'decimal_rate' THEN 100.0 ELSE 1.0 END END) AS \"value\" FROM observations GROUP BY 1, 2")
def ingested_units(s, d):
    unit, factor = Q.ingested_unit(F.col("unit"))
    v = F.when(~F.isnan("value"), F.col("value") * factor)
    return table(s, d, "observations").groupBy("observation_id", unit.alias("unit")).agg(F.max(v).alias("value"))


#: Routes of questions (configuration).
FIRST = [("legal", ["제출 기한", "deadline"]), ("traffic", ["교통량", "건수", "how many cases"])]
ROUTES = {"plant": ["정수장", "기준", "점검", "limit", "checked", "filtration"], "market": ["지수", "업종", "영향", "index", "firms", "mean for"], "operation": ["해야", "급변", "what should", "jumps"]}


def _route_sql() -> str:
    q = "lower(coalesce(question, ''))"
    n = {r: "(" + " + ".join(f"contains({q}, '{w}')::INT" for w in ws) + ")" for r, ws in ROUTES.items()}
    first = " ".join("WHEN " + " OR ".join(f"contains({q}, '{w}')" for w in ws) + f" THEN '{r}'" for r, ws in FIRST)
    rest = " ".join(f"WHEN {c} > 0 AND {c} - greatest({', '.join(o for k, o in n.items() if k != r)}) >= 1 THEN '{r}'" for r, c in n.items())
    return f"CASE {first} {rest} ELSE 'general' END"


@query(_QA + f" SELECT qa_id, {_route_sql()} route FROM q")
def question_routes(s, d):
    return qa(s, d).select("qa_id", Q.route("question", FIRST, ROUTES, "general").alias("route"))


@query(_QA + r", p AS (SELECT qa_id, regexp_extract(trim(question), '^([가-힣]+ (?:입구|사거리|삼거리|네거리|정수장|교차로|오거리))', 1) || regexp_extract(trim(question), '^[가-힣]+ (?:입구|사거리|삼거리|네거리|정수장|교차로|오거리)([가-힣]*)', 1) x FROM q) SELECT qa_id, nullif(regexp_replace(trim(x), '(?:에서의|에서|으로|까지|부터|에는|에|로|의|은|는|이|가|을|를)$', ''), '') place FROM p WHERE x <> ''")
def question_places(s, d):
    """The place a question begins with, without particles."""
    x = F.regexp_extract(F.trim("question"), "^([가-힣]+ (?:입구|사거리|삼거리|네거리|정수장|교차로|오거리)[가-힣]*)", 1)
    return qa(s, d).select("qa_id", x.alias("x")).where("x <> ''").select("qa_id", Q.place("x").alias("place"))


_Q0 = "lower(coalesce(question, ''))"
_SL = _QA + f""", sl AS (SELECT qa_id, CASE WHEN regexp_matches({_Q0}, '평균|average|mean') THEN 'avg' WHEN regexp_matches({_Q0}, '합계|총|total|sum of') THEN 'sum' WHEN regexp_matches({_Q0}, '최대|가장 높|highest|maximum') THEN 'max' WHEN regexp_matches({_Q0}, '최소|가장 낮|lowest|minimum') THEN 'min' WHEN regexp_matches({_Q0}, '몇|건수|how many|count') THEN 'count' END ag,
CASE WHEN regexp_matches({_Q0}, '시간대|hourly|per hour') THEN 'hour' WHEN regexp_matches({_Q0}, '일별|daily|per day') THEN 'day' WHEN regexp_matches({_Q0}, '월별|monthly|per month') THEN 'month' END pe FROM q)"""


@query(_SL + " SELECT qa_id, 'SELECT ' || coalesce('date_trunc(''' || pe || ''', ts) AS period, ', '') || CASE WHEN ag = 'count' THEN 'count(*)' ELSE coalesce(ag, 'avg') || '(value)' END || ' AS result FROM events' || coalesce(' GROUP BY date_trunc(''' || pe || ''', ts)', '') statement FROM sl")
def slot_statements(s, d):
    """The SELECT over events that the slots of every question give."""
    sl = Q.slots("question")
    return qa(s, d).select("qa_id", Q.statement("events", "value", "ts", sl).alias("statement"))


@query(_QA + f" SELECT CASE WHEN regexp_matches({_Q0}, '왜|원인|why|because') THEN 'cause' WHEN regexp_matches({_Q0}, '영향|이후|effect|mean for|how did') THEN 'effect' WHEN regexp_matches({_Q0}, '비교|차이|compare|difference') THEN 'compare' WHEN regexp_matches({_Q0}, '하면|되면|when |if ') THEN 'condition' ELSE 'fact' END kind, count(*) n FROM q GROUP BY 1")
def reasoning_kinds(s, d):
    return qa(s, d).groupBy(Q.reasoning("question").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS \"last\", round(avg(value), 6) mean FROM events GROUP BY 1")
def sql_executor(s, d):
    """A SELECT run as text, times as ISO text."""
    from vintagraph.sources.readers import run_select

    return run_select(s, "SELECT event_type, max(ts) AS last, round(avg(value), 6) AS mean FROM events GROUP BY event_type", {"events": table(s, d, "events")})
