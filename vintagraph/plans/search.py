"""Queries over the corpus: text functions, search and selection, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vintagraph.functions import text as T
from vintagraph.operators import retrieval as R
from vintagraph.plans.registry import Registry
from vintagraph.session import cut
from vintagraph.sources.tables import table, unique

query = Registry()
QUERIES, SQL = query.queries, query.sql


def docs(s, d):
    return table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text", "source")


def questions(s, d):
    return table(s, d, "eval_items").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[\x{{2010}}-\x{{2015}}]', '-', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', E'\n\n', 'g'), '^[ \n\r\t]+|[ \n\r\t]+$', '', 'g')"""
_W = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


@query("SELECT doc_id, md5(" + _CLEAN.format("text") + ") h, length(" + _CLEAN.format("text") + ") n FROM documents WHERE text IS NOT NULL")
def text_clean(s, d):
    return docs(s, d).select(F.col("id").alias("doc_id"), F.md5(T.clean("text")).alias("h"), F.length(T.clean("text")).alias("n"))


@query("SELECT doc_id, len(w) n_words, len(list_distinct(w)) n_distinct FROM (SELECT doc_id, " + _W.format("text") + " w FROM documents WHERE text IS NOT NULL)")
def word_tokens(s, d):
    return docs(s, d).select(F.col("id").alias("doc_id"), F.size(T.words("text")).alias("n_words"), F.size(F.array_distinct(T.words("text"))).alias("n_distinct"))


_GRAMS = r"list_concat(list_concat([substr(t, i, 3) FOR i IN range(1, greatest(length(t) - 1, 1))], [substr(t, i, 4) FOR i IN range(1, greatest(length(t) - 2, 1))]), [substr(t, i, 5) FOR i IN range(1, greatest(length(t) - 3, 1))])"
_NG = rf"WITH dg AS (SELECT id, {_GRAMS} g FROM (SELECT doc_id id, regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g') t FROM documents WHERE text IS NOT NULL)), qg AS (SELECT qid, {_GRAMS} g FROM (SELECT item_id qid, regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g') t FROM eval_items))"


@query(_NG + ", p AS (SELECT id, unnest(g) term FROM dg), a AS (SELECT id, term, count(*) tf FROM p GROUP BY 1, 2) SELECT id AS doc_id, count(*) n_terms, sum(tf)::BIGINT n_grams, max(tf) top_tf FROM a GROUP BY 1")
def ngram_postings(s, d):
    p, _ = R.postings(docs(s, d), T.ngrams("text"))
    return p.groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_grams"), F.max("tf").alias("top_tf"))


_BM = _NG + """, q AS (SELECT DISTINCT qid, unnest(g) term FROM qg), e AS (SELECT id, unnest(g) term FROM dg), p AS (SELECT id, term, count(*) tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
st AS (SELECT count(*) n, avg(len(g)) a FROM dg), f AS (SELECT term, ln(1 + ((SELECT n FROM st) - count(*) + 0.5) / (count(*) + 0.5)) idf FROM p GROUP BY 1),
w AS (SELECT p.id, p.term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(g) / ((SELECT a FROM st) + 1e-9)) + 1e-9) x FROM p JOIN f USING (term) JOIN dg USING (id)),
s0 AS (SELECT qid, id, sum(x) score FROM w JOIN q USING (term) GROUP BY 1, 2),
bm AS (SELECT qid, id, score * CASE WHEN contains(lower(d.text), lower(i.text)) THEN 2 ELSE 1 END score FROM s0 JOIN documents d ON d.doc_id = id JOIN eval_items i ON i.item_id = qid),
bk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id)::INT "rank" FROM bm) WHERE "rank" <= 20)"""
_TF = ", td AS (SELECT doc_id id, unnest(" + _W.format("text") + ") term FROM documents WHERE text IS NOT NULL), tq AS (SELECT item_id qid, unnest(" + _W.format("text") + """) term FROM eval_items),
tp AS (SELECT id, term, count(*) tf FROM td GROUP BY 1, 2), ti AS (SELECT term, ln(((SELECT count(*) FROM documents WHERE text IS NOT NULL) + 1) / (count(*) + 1)) + 1 idf FROM tp GROUP BY 1),
tw AS (SELECT id, term, tf * idf w FROM tp JOIN ti USING (term)), tn AS (SELECT id, sqrt(sum(w * w)) dn FROM tw GROUP BY 1),
qw AS (SELECT qid, term, count(*) * any_value(idf) w FROM tq JOIN ti USING (term) GROUP BY 1, 2), qn AS (SELECT qid, sqrt(sum(w * w)) qn FROM qw GROUP BY 1),
ts AS (SELECT qid, id, sum(tw.w * qw.w) / (any_value(dn) * any_value(qn)) score FROM tw JOIN qw USING (term) JOIN tn USING (id) JOIN qn USING (qid) GROUP BY 1, 2),
tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id)::INT "rank" FROM ts) WHERE "rank" <= 20)"""


def bm_top(s, d, k=20):
    return R.top(R.bm25(docs(s, d), questions(s, d), k=k), k)


def tf_top(s, d, k=20):
    return R.top(R.tfidf(docs(s, d), questions(s, d)), k)


def with_text(s, d, hits):
    return hits.join(questions(s, d), "qid").join(docs(s, d), "id")


@query(_BM + ' SELECT qid, id, round(score, 4) score, "rank" FROM bk')
def bm25_topk(s, d):
    return bm_top(s, d).withColumn("score", F.round("score", 4))


@query(_NG + _TF + ' SELECT qid, id, round(score, 6) score, "rank" FROM tk')
def tfidf_topk(s, d):
    return tf_top(s, d).withColumn("score", F.round("score", 6))


_V = """WITH v AS (SELECT vec_id id, embedding::DOUBLE[] e FROM embeddings), s AS (SELECT a.id qid, b.id, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) score FROM v a JOIN v b ON a.id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id)::INT "rank" FROM s)"""


def vec_top(s, d, k=10):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return R.vector_top(v, v.where("id % 100 = 0").select(F.col("id").alias("qid"), "v"), k)


@query(_V + ' SELECT qid, id, round(score, 6) score, "rank" FROM k WHERE "rank" <= 10')
def vector_topk(s, d):
    return vec_top(s, d).withColumn("score", F.round("score", 6))


_MM = """(score - min(score) OVER (PARTITION BY qid)) / nullif(max(score) OVER (PARTITION BY qid) - min(score) OVER (PARTITION BY qid), 0)"""
_FU = _BM + _TF + f", m AS (SELECT qid, id, 0.6 * coalesce({_MM}, 1) x FROM bk UNION ALL SELECT qid, id, 0.4 * coalesce({_MM}, 1) FROM tk), fu AS (SELECT qid, id, sum(x) score FROM m GROUP BY 1, 2)"


def fused(s, d):
    return R.fuse([(bm_top(s, d), 0.6), (tf_top(s, d), 0.4)])


@query(_FU + " SELECT qid, id, round(score, 6) score FROM fu")
def fusion_minmax(s, d):
    return fused(s, d).withColumn("score", F.round("score", 6))


@query(_BM + _TF + ', m AS (SELECT qid, id, 0.6 / (60 + "rank") x FROM bk UNION ALL SELECT qid, id, 0.4 / (60 + "rank") FROM tk) SELECT qid, id, round(sum(x), 9) score FROM m GROUP BY 1, 2')
def rrf(s, d):
    return R.rrf([(bm_top(s, d), 0.6), (tf_top(s, d), 0.4)]).withColumn("score", F.round("score", 9))


@query(_BM + _TF + f", u AS (SELECT qid, id, coalesce({_MM}, 1) x, 1.0 w FROM bk UNION ALL SELECT qid, id, coalesce({_MM}, 1), 0.3 FROM tk) SELECT qid, id, round(sum(x * w) / sum(w), 6) score, count(*) n_models, round(CASE WHEN count(*) = 1 THEN 0.5 ELSE greatest(0, 1 - var_pop(x)) END, 6) agreement FROM u GROUP BY 1, 2")
def ensemble_search(s, d):
    e = R.ensemble({"bm25": (bm_top(s, d), 1.0), "tfidf": (tf_top(s, d), 0.3)})
    return e.withColumn("score", F.round("score", 6)).withColumn("agreement", F.round("agreement", 6))


_OV = "len(list_intersect(list_distinct({0}), {1})) / len(list_distinct({0}))"
_RR = _FU + ", h AS (SELECT f.qid, f.id, f.score, d.text, i.text query, " + _W.format("d.text") + " dw, " + _W.format("i.text") + """ w FROM fu f JOIN documents d ON d.doc_id = f.id JOIN eval_items i ON i.item_id = f.qid),
rs AS (SELECT qid, id, round(CASE WHEN contains(lower(text), lower(query)) THEN 1.0 ELSE 0.0 END + 0.5 * """ + _OV.format("w", "dw") + """ + 0.3 * score + 0.2 * len(list_intersect(list_distinct(w), dw)) / len(list_distinct(list_concat(w, dw))), 9) score FROM h),
rm AS (SELECT qid, id, coalesce(""" + _MM + """, 1) score FROM rs), rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id)::INT "rank" FROM rm)"""


@query(_RR + ' SELECT qid, id, round(score, 5) score, "rank" FROM rk WHERE score >= 0.41 OR "rank" = 1')
def rerank_threshold(s, d):
    return R.rerank(with_text(s, d, fused(s, d))).withColumn("score", F.round("score", 5))


@query(_BM + ", z AS (SELECT qid, id, (score - avg(score) OVER (PARTITION BY qid)) / nullif(stddev_pop(score) OVER (PARTITION BY qid), 0) z FROM bk) SELECT qid, id, round(coalesce((greatest(-3, least(3, z)) + 3) / 6, 0.5), 5) score, CASE WHEN coalesce((greatest(-3, least(3, z)) + 3) / 6, 0.5) >= 0.8 THEN 'high' WHEN coalesce((greatest(-3, least(3, z)) + 3) / 6, 0.5) >= 0.6 THEN 'medium' WHEN coalesce((greatest(-3, least(3, z)) + 3) / 6, 0.5) >= 0.4 THEN 'low' ELSE 'very_low' END band FROM z")
def calibrated_filter(s, d):
    z = R.zclip(bm_top(s, d))
    return z.select("qid", "id", F.round("score", 5).alias("score"), T.band(F.col("score")).alias("band"))


_G3 = r"list_distinct([substr(t, i, 3) FOR i IN range(1, greatest(length(t) - 1, 1))])"
_LOW = r"regexp_replace(lower({0}), '[ \t\n\x0B\f\r]+', ' ', 'g')"


@query(_BM + ", h AS (SELECT qid, id, (SELECT " + _G3 + " FROM (SELECT " + _LOW.format("i.text") + " t)) q, (SELECT " + _G3 + " FROM (SELECT " + _LOW.format("d.text") + " t)) g FROM bk JOIN documents d ON d.doc_id = id JOIN eval_items i ON i.item_id = qid) SELECT qid, id, round(len(list_intersect(q, g)) / len(q), 6) overlap FROM h WHERE len(list_intersect(q, g)) / len(q) >= 0.07")
def context_filter(s, d):
    return R.context_filter(with_text(s, d, bm_top(s, d))).select("qid", "id", F.round("overlap", 6).alias("overlap"))


@query(_BM + ", cw AS (SELECT DISTINCT qid, unnest(" + _W.format("d.text") + ") w FROM bk JOIN documents d ON d.doc_id = id WHERE \"rank\" <= 3), q2 AS (SELECT DISTINCT item_id qid, unnest(" + _W.format("text") + """) w FROM eval_items),
o AS (SELECT q2.qid, avg((cw.w IS NOT NULL)::INT) ov, avg((cw.w IS NOT NULL)::INT) FILTER (length(q2.w) >= 2) cv, (SELECT count(*) FROM cw c WHERE c.qid = q2.qid) n FROM q2 LEFT JOIN cw ON cw.qid = q2.qid AND cw.w = q2.w GROUP BY 1),
r AS (SELECT qid, CASE WHEN n = 0 THEN 'no_context' WHEN ov < 0.1 THEN 'low_overlap' WHEN coalesce(cv, 1) < 0.3 THEN 'low_coverage' END reason FROM o) SELECT qid, reason IS NOT NULL blocked, reason FROM r""")
def guardrail(s, d):
    return R.guardrail(with_text(s, d, bm_top(s, d, 3)), questions(s, d))


@query(_BM + ', u AS (SELECT qid, id, "rank", sum(length(text) // 4) OVER (PARTITION BY qid ORDER BY "rank") used FROM bk JOIN documents ON doc_id = id) SELECT qid, id, "rank", used::BIGINT used FROM u WHERE used <= 800 OR "rank" <= 1')
def budget_topk(s, d):
    return R.budgeted(with_text(s, d, bm_top(s, d)), 800).select("qid", "id", "rank", "used")


@query(_BM + ', u AS (SELECT qid, id, source, "rank", row_number() OVER (PARTITION BY qid, source ORDER BY "rank") r FROM bk JOIN documents ON doc_id = id) SELECT qid, id, source, "rank" FROM u WHERE r <= 2')
def diversity_cap(s, d):
    return R.diverse(with_text(s, d, bm_top(s, d)), "source").select("qid", "id", "source", "rank")


@query(_NG + _TF + ', w AS (SELECT qid, score, [1.0, 0.7, 0.5, 0.3, 0.1]["rank"] w FROM tk WHERE "rank" <= 5) SELECT qid, round(sum(score * w) / sum(w), 6) confidence FROM w GROUP BY 1')
def response_confidence(s, d):
    return R.confidence(tf_top(s, d)).withColumn("confidence", F.round("confidence", 6))


@query(_NG + _TF + ", t AS (SELECT item_id qid, CASE WHEN regexp_matches(lower(text), '[0-9]|얼마|몇') THEN 8 ELSE 6 END k FROM eval_items) SELECT qid, id, \"rank\" FROM tk JOIN t USING (qid) WHERE \"rank\" <= k")
def dynamic_k(s, d):
    k = F.when(F.lower("query").rlike("[0-9]|얼마|몇"), 8).otherwise(6)
    return tf_top(s, d).join(questions(s, d).select("qid", k.alias("k")), "qid").where("rank <= k").select("qid", "id", "rank")


@query("WITH k AS (SELECT doc_id id, md5(lower(regexp_replace(" + _CLEAN.format("text") + r", '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS key FROM documents WHERE text IS NOT NULL) SELECT key, min(id) keep, count(*) n FROM k GROUP BY 1")
def exact_dup(s, d):
    return R.exact_groups(docs(s, d))


@query()
def greedy_dedup(s, d):
    return R.greedy_dedup(with_text(s, d, bm_top(s, d)))


@query()
def mmr(s, d):
    return R.mmr(with_text(s, d, R.minmax(bm_top(s, d))))


@query(_V + ", g AS (SELECT (score + 1) / 2 score, a.label = b.label good FROM k JOIN embeddings a ON a.vec_id = qid JOIN embeddings b ON b.vec_id = id WHERE \"rank\" <= 10), n AS (SELECT count(*) FILTER (good) a FROM g), t AS (SELECT unnest(range(51)) / 50 threshold), r AS (SELECT threshold, avg(good::INT) p, count(*) FILTER (good) / (SELECT a FROM n) r FROM t JOIN g ON score >= threshold GROUP BY 1) SELECT threshold, round(p, 6) AS \"precision\", round(r, 6) recall FROM r WHERE p >= 0.9 ORDER BY threshold LIMIT 1")
def threshold_calibration(s, d):
    l = table(s, d, "embeddings").select("vec_id", "label")
    j = vec_top(s, d).join(l.select(F.col("vec_id").alias("qid"), F.col("label").alias("a")), "qid").join(l.select(F.col("vec_id").alias("id"), F.col("label").alias("b")), "id")
    b = R.best_threshold(cut(j.select(((F.col("score") + 1) / 2).alias("score"), (F.col("a") == F.col("b")).alias("good"))), 0.9)
    return b.select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)? ?(?:" + "|".join(sorted(T.UNITS, key=len, reverse=True)) + r")')) m FROM documents WHERE text IS NOT NULL")
def measurements(s, d):
    return docs(s, d).select(F.col("id").alias("doc_id"), F.explode(T.measurements("text")).alias("m"))


@query(r"WITH x AS (SELECT doc_id, regexp_extract(text, '([0-9]{4})(?:년 ?|[./-])([0-9]{1,2})(?:월 ?|[./-])([0-9]{1,2})', ['y', 'm', 'd']) g FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN g.y <> '' THEN g.y || '-' || lpad(g.m, 2, '0') || '-' || lpad(g.d, 2, '0') END iso FROM x")
def date_normalise(s, d):
    return docs(s, d).select(F.col("id").alias("doc_id"), T.iso_date("text").alias("iso"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) h FROM documents WHERE text IS NOT NULL")
def content_hashes(s, d):
    return docs(s, d).select(F.col("id").alias("doc_id"), T.content_hash("text").alias("h"))


@query(r"""WITH x AS (SELECT doc_id, text t, greatest(length(text), 1) n FROM documents WHERE text IS NOT NULL) SELECT doc_id, round(greatest(0, least(1, 0.4 * len(regexp_extract_all(t, '\x{FFFD}')) / n + 0.4 * len(regexp_extract_all(t, '[|~^`\\]')) / greatest(1, n / 20.0) + 0.2 * len(regexp_extract_all(t, '[^\p{L}\p{N}\t\n\v\f\r ]')) / n)), 6) noise FROM x""")
def noise_score(s, d):
    return docs(s, d).select(F.col("id").alias("doc_id"), F.round(T.noise("text"), 6).alias("noise"))


@query(r"""WITH x AS (SELECT qa_id, lower(question) q FROM (SELECT DISTINCT ON (qa_id) * FROM qa_pairs ORDER BY qa_id)) SELECT qa_id, CASE WHEN regexp_matches(q, '[0-9]|얼마|몇|how many|how much|what is the limit') THEN 'numeric' WHEN regexp_matches(q, '어떻게|해야|should|how often|how did') THEN 'procedure' WHEN regexp_matches(q, '무엇|란 |정의|what does|mean') THEN 'definition' WHEN regexp_matches(q, '기한|언제|deadline|when') THEN 'deadline' ELSE 'general' END kind FROM x""")
def question_types(s, d):
    return unique(s, d, "qa_pairs", "qa_id").select("qa_id", T.question_type("question").alias("kind"))


@query(r"""WITH x AS (SELECT doc_id, lower(text) t FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, regexp_matches(t, '상승|증가|올랐|rose|grew') p, regexp_matches(t, '하락|감소|줄|fell|lower') n FROM x) SELECT doc_id, CASE WHEN p AND n THEN 'mixed' WHEN p THEN '+' WHEN n THEN '-' END polarity FROM y""")
def text_polarity(s, d):
    return docs(s, d).select(F.col("id").alias("doc_id"), T.polarity("text", ["상승", "증가", "올랐", "rose", "grew"], ["하락", "감소", "줄", "fell", "lower"]).alias("polarity"))


@query(r"""SELECT doc_id, 'art-' || coalesce(nullif(regexp_extract(text, '제 ?([0-9]+) ?조', 1), ''), nullif(regexp_extract(lower(text), 'section ([0-9]+)', 1), '')) article FROM documents WHERE text IS NOT NULL""")
def legal_refs(s, d):
    return docs(s, d).select(F.col("id").alias("doc_id"), T.article("text").alias("article"))


@query("""WITH x AS (SELECT doc_id, text t, substr(text, 1, 200) h FROM documents WHERE text IS NOT NULL), y AS (SELECT *, regexp_extract(h, '(?s)^(.*[.\\n])', 1) k FROM x) SELECT doc_id, CASE WHEN length(t) <= 200 THEN t WHEN length(k) > 140 THEN rtrim(k, ' ') ELSE h || '...' END short FROM y""".replace("\\\\n", "\\n"))
def truncate_sentence(s, d):
    return docs(s, d).select(F.col("id").alias("doc_id"), T.truncate("text", 200).alias("short"))


@query(r"SELECT event_id, props->>'$.k' k, (props->>'$.k')::BIGINT n FROM events")
def json_props(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.from_json("props", "k bigint")["k"].alias("n"))


@query("WITH x AS (SELECT id, pdf_file_id, page_number, content, lag(id) OVER w p, lead(id) OVER w n FROM text_chunks WINDOW w AS (PARTITION BY pdf_file_id ORDER BY id)) SELECT id, coalesce(p, -1) prev_id, coalesce(n, -1) next_id FROM x")
def neighbour_chunks(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("pdf_file_id").orderBy("id")
    return table(s, d, "text_chunks").select("id", F.lag("id", 1, -1).over(w).alias("prev_id"), F.lead("id", 1, -1).over(w).alias("next_id"))


@query("WITH w AS (SELECT doc_id, unnest(" + _W.format("text") + ") w FROM documents WHERE text IS NOT NULL), c AS (SELECT w, count(*) n, count(DISTINCT doc_id) docs FROM w WHERE length(w) BETWEEN 2 AND 20 AND NOT regexp_matches(w, '^[0-9]+$') GROUP BY 1) SELECT w word, n, docs FROM c WHERE docs >= 5")
def keywords(s, d):
    w = docs(s, d).select("id", F.explode(T.words("text")).alias("word")).where((F.length("word").between(2, 20)) & ~F.col("word").rlike("^[0-9]+$"))
    per = w.groupBy("word", "id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")).where("docs >= 5")
