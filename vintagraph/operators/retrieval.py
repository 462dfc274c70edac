"""Search over a corpus: postings, BM25, TF-IDF, vectors, fusion, filters, reranking, selection.

Queries are a DataFrame (qid, query); every stage handles all of them at once. Ranks break ties by the smaller id,
on scores rounded to 9 places, so that a result does not depend on the order of summation.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagraph.functions import text as T
from vintagraph.session import cut, small, spread

K1, B, EPS = 1.5, 0.75, 1e-9
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
#: Constant of reciprocal rank fusion, trade-off of MMR.
RRF, LAMBDA = 60, 0.7


def top(scored: DataFrame, k, qid: str = "qid", id_: str = "id", score: str = "score") -> DataFrame:
    """The k best per query with ``rank``; k is a number or a column. The limit works before the shuffle."""
    w = Window.partitionBy(qid).orderBy(F.round(score, 9).desc(), id_)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def postings(docs: DataFrame, terms: Column, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, term, tf) and (id, dl): term counts of each document, of the terms in ``only`` if given, and lengths.

    Documents are aggregated where they are read: lengths need no shuffle, and terms no query has are dropped before it.
    """
    t = docs.select("id", terms.alias("_t"))
    length = t.select("id", F.size("_t").alias("dl"))
    e = t.select("id", F.explode("_t").alias("term"))
    if only is not None:
        e = e.join(only, "term", "left_semi")
    return e.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")), length


def gram_counts(rows: DataFrame, lo: int = 3, hi: int = 5) -> DataFrame:
    """id, term, tf of the character n-grams of ``rows`` (id, text), as ``text.ngrams`` has them.

    In Python: array functions take some 2.5 microseconds a gram here, a Counter a tenth of that. One row per distinct
    gram of a text comes back, so the transfer is already aggregated.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 64):
                ids, terms, tfs = [], [], []
                for i, t in zip(b["id"].iloc[at : at + 64], b["text"].iloc[at : at + 64]):
                    t = _SPACE.sub(" ", (t or "").lower())
                    c = Counter(t[j : j + n] for n in range(lo, hi + 1) for j in range(len(t) - n + 1))
                    ids += [i] * len(c)
                    terms += c.keys()
                    tfs += c.values()
                if ids:
                    yield pd.DataFrame({"id": ids, "term": terms, "tf": tfs})

    return rows.select("id", "text").mapInPandas(run, "id bigint, term string, tf bigint")


def bm25(docs: DataFrame, queries: DataFrame, double_exact: bool = True, k: int | None = None) -> DataFrame:
    """qid, id, score by character n-grams over documents (id, text) sharing one with the query; query counts play no part.

    A document that holds the whole query counts double. With ``k``, only what can be among the k best of a query goes
    on to that test: scores of at least half the k-th, as the factor is 2 at most.
    """
    qt = gram_counts(queries.select(F.col("qid").alias("id"), F.col("query").alias("text"))).select(F.col("id").alias("qid"), "term")
    qt = cut(qt)
    vocabulary = small(cut(qt.select("term").distinct()), 500_000)
    p = cut(gram_counts(spread(docs.select("id", "text"))).join(vocabulary, "term", "left_semi"))
    n = F.length(F.regexp_replace(F.lower("text"), r"\s+", " "))
    grams = lambda k: F.greatest(n - k + 1, F.lit(0))
    length = docs.select("id", (grams(3) + grams(4) + grams(5)).alias("dl"))
    stats = length.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = df.join(F.broadcast(stats)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl")
    # query terms and weights are as large as the query set: broadcast while that is small, so that the documents'
    # scores are summed before they are shuffled
    j = p.join(length, "id").join(small(cut(w), 500_000), "term")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / (F.col("avgdl") + EPS)) + EPS)
    s = j.select("id", "term", part.alias("part")).join(small(qt, 500_000), "term").groupBy("qid", "id").agg(F.sum("part").alias("score"))
    if double_exact:
        if k is not None:
            s = cut(s)
            kth = top(s, k).where(F.col("rank") == k).select("qid", (F.col("score") / 2 - 1e-6).alias("_least"))
            s = s.join(kth, "qid", "left").where(F.col("score") >= F.coalesce("_least", F.lit(0.0))).drop("_least")
        x = s.join(queries, "qid").join(docs.select("id", "text"), "id")
        s = x.select("qid", "id", (F.col("score") * F.when(F.contains(F.lower("text"), F.lower("query")), 2).otherwise(1)).alias("score"))
    return s


def tfidf(docs: DataFrame, queries: DataFrame, terms=T.words) -> DataFrame:
    """qid, id, score: cosine of tf times ln((N + 1) / (df + 1)) + 1.

    Document frequencies are summed first; then each document's norm is summed with the weights of all its words, and
    only words that a query has go on to the scores.
    """
    p, length = postings(docs, terms("text"))
    p = cut(p)
    n = length.agg(F.count(F.lit(1)).alias("n"))
    q, _ = postings(queries.select(F.col("qid").alias("id"), F.col("query").alias("text")), terms("text"))
    q = cut(q.withColumnRenamed("id", "qid").withColumnRenamed("tf", "qtf"))
    asked = q.select("term").distinct().withColumn("asked", F.lit(True))
    df = p.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n))  # one row
    idf = cut(df.select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf")).join(asked, "term", "left"))
    d = p.join(small(idf, 500_000), "term").select("id", "term", "asked", (F.col("tf") * F.col("idf")).alias("w"))
    # one grouping by document: its norm, and the weights of the words that count
    hit = F.collect_list(F.when(F.col("asked"), F.struct("term", "w"))).alias("_t")
    own = d.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"), hit).where("size(_t) > 0")
    own = own.select("id", "dn", F.explode_outer("_t").alias("_t")).select("id", "dn", "_t.term", "_t.w")
    qw = q.join(idf, "term").select("qid", "term", (F.col("qtf") * F.col("idf")).alias("qw"))
    qn = qw.groupBy("qid").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    asks = cut(qw.join(qn, "qid"))
    s = own.join(small(asks, 500_000), "term").groupBy("qid", "id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"), F.max("dn").alias("dn"), F.max("qn").alias("qn"))
    return s.select("qid", "id", F.try_divide("dot", F.col("dn") * F.col("qn")).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_top(docs: DataFrame, queries: DataFrame, k: int, block: int = 1000) -> DataFrame:
    """qid, id, score, rank: exact cosine of a stated query set against all vectors (id, v).

    Queries are sent along in blocks of ``block``; each block is held against all vectors where they are read and only
    the k best of a partition go on. Vectors of another length than the query's, null and zero ones take no part.
    """
    unit = lambda df, i: df.where(F.col("v").isNotNull() & (F.size("v") > 0)).select(F.col(i).cast("bigint").alias(i), F.transform("v", lambda x: x.cast("double")).alias("v"))
    d, q = spread(unit(docs, "id")), cut(unit(queries, "qid"))
    parts = max(1, -(-q.count() // block))
    q = q.withColumn("_b", F.pmod(F.xxhash64("qid"), F.lit(parts)))
    out = None
    for b in range(parts):
        part = q.where(F.col("_b") == b).toPandas()  # about ``block`` vectors
        shared = docs.sparkSession.sparkContext.broadcast((part["qid"].to_numpy(), [np.asarray(v, dtype=float) for v in part["v"]]))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, vs = shared.value
            sizes = np.array([len(v) for v in vs])
            for f in batches:
                n = f["v"].str.len().to_numpy()
                for size in np.unique(n):
                    mine = np.flatnonzero(sizes == size)
                    x = np.stack(f["v"][n == size].to_numpy())
                    xi, xn = f["id"][n == size].to_numpy(), np.linalg.norm(x, axis=1)
                    x, xi = x[xn > 0] / xn[xn > 0, None], xi[xn > 0]
                    if not len(mine) or not len(x):
                        continue
                    m = np.stack([vs[i] for i in mine])
                    mn = np.linalg.norm(m, axis=1)
                    m, qi = m[mn > 0] / mn[mn > 0, None], ids[mine][mn > 0]
                    s = np.round(m @ x.T, 9)
                    for row, asked in zip(s, qi):
                        best = np.lexsort((xi, -row))[:k]
                        yield pd.DataFrame({"qid": asked, "id": xi[best], "score": row[best]})

        found = d.select("id", "v").mapInPandas(run, "qid bigint, id bigint, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "qid bigint, id bigint, score double")
    return top(out, k)


def minmax(scored: DataFrame, empty: float = 1.0) -> DataFrame:
    """Scores of each query scaled to 0..1; ``empty`` where all are equal."""
    w = Window.partitionBy("qid")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return scored.withColumn("score", F.coalesce(F.try_divide(F.col("score") - lo, hi - lo), F.lit(empty)))


def zclip(scored: DataFrame) -> DataFrame:
    """Scores as z clipped to +-3, scaled to 0..1; .5 where nothing varies."""
    w = Window.partitionBy("qid")
    z = F.try_divide(F.col("score") - F.avg("score").over(w), F.stddev_pop("score").over(w))
    return scored.withColumn("score", F.coalesce((F.greatest(F.lit(-3.0), F.least(F.lit(3.0), z)) + 3) / 6, F.lit(0.5)))


def fuse(lists: list[tuple[DataFrame, float]]) -> DataFrame:
    """qid, id, score: weighted sum of min-max scaled lists; a list without the document adds 0."""
    parts = [minmax(df).select("qid", "id", (F.col("score") * w).alias("score")) for df, w in lists]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("qid", "id").agg(F.sum("score").alias("score"))


def rrf(lists: list[tuple[DataFrame, float]]) -> DataFrame:
    """qid, id, score: sum of w / (60 + rank) over ranked lists."""
    u = None
    for df, w in lists:
        p = df.select("qid", "id", (w / (RRF + F.col("rank"))).alias("score"))
        u = p if u is None else u.unionByName(p)
    return u.groupBy("qid", "id").agg(F.sum("score").alias("score"))


def rerank(hits: DataFrame, threshold: float = 0.41) -> DataFrame:
    """hits (qid, id, query, text, score) by exact match, share of query words hit, score and overlap; min-max, cut at the threshold, at least one kept."""
    qw, dw = F.array_distinct(T.words("query")), T.words("text")
    r = F.when(F.contains(F.lower("text"), F.lower("query")), 1.0).otherwise(0.0) + 0.5 * T.overlap(qw, dw) + 0.3 * F.col("score") + 0.2 * T.jaccard(qw, dw)
    s = top(minmax(hits.select("qid", "id", F.round(r, 9).alias("score"))), 2**31 - 1)
    return s.where((F.col("score") >= threshold) | (F.col("rank") == 1))


def context_filter(hits: DataFrame, least: float = 0.07) -> DataFrame:
    """Hits whose 3-gram overlap with the query is at least ``least``."""
    o = T.overlap(T.ngrams("query", 3, 3), T.ngrams("text", 3, 3))
    return hits.withColumn("overlap", o).where(F.col("overlap") >= least)


def guardrail(hits: DataFrame, queries: DataFrame, least: float = 0.10, coverage: float = 0.3) -> DataFrame:
    """qid, blocked, reason: by the overlap of the query's words with all its contexts together; no context blocks."""
    w = hits.select("qid", F.explode(F.array_distinct(T.words("text"))).alias("w")).distinct()
    q = queries.select("qid", F.explode(F.array_distinct(T.words("query"))).alias("w"))
    have = q.join(w.withColumn("_h", F.lit(1)), ["qid", "w"], "left").groupBy("qid").agg(F.avg(F.coalesce("_h", F.lit(0))).alias("overlap"), F.avg(F.when(F.length("w") >= 2, F.coalesce("_h", F.lit(0)))).alias("cover"))
    any_ = hits.select("qid").distinct().withColumn("_c", F.lit(True))
    j = queries.select("qid").join(have, "qid", "left").join(any_, "qid", "left")
    reason = F.when(F.col("_c").isNull(), "no_context").when(F.coalesce("overlap", F.lit(0.0)) < least, "low_overlap").when(F.coalesce("cover", F.lit(1.0)) < coverage, "low_coverage")
    return j.select("qid", reason.isNotNull().alias("blocked"), reason.alias("reason"))


def budgeted(ranked: DataFrame, tokens: int, least: int = 1) -> DataFrame:
    """Best first while the running sum of length // 4 fits; the first ``least`` are kept anyway."""
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    r = ranked.withColumn("used", F.sum(F.floor(F.length("text") / 4)).over(w))
    return r.where((F.col("used") <= tokens) | (F.col("rank") <= least))


def diverse(ranked: DataFrame, per: str, most: int = 2) -> DataFrame:
    """At most ``most`` hits of each value of ``per`` in a query."""
    w = Window.partitionBy("qid", per).orderBy("rank")
    return ranked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def confidence(ranked: DataFrame) -> DataFrame:
    """qid, confidence: mean of the five best scores weighted 1, .7, .5, .3, .1."""
    w = F.element_at(F.array(*[F.lit(x) for x in (1.0, 0.7, 0.5, 0.3, 0.1)]), F.col("rank"))
    r = ranked.where("rank <= 5").withColumn("_w", w)
    return r.groupBy("qid").agg((F.sum(F.col("score") * F.col("_w")) / F.sum("_w")).alias("confidence"))


def ensemble(lists: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """qid, id, score, n_models, agreement: weighted mean over the models that found it; agreement is 1 - variance, .5 for one."""
    u = None
    for name, (df, w) in lists.items():
        p = minmax(df).select("qid", "id", "score", F.lit(w).alias("w"), F.lit(name).alias("model"))
        u = p if u is None else u.unionByName(p)
    g = u.groupBy("qid", "id").agg((F.sum(F.col("score") * F.col("w")) / F.sum("w")).alias("score"), F.count(F.lit(1)).alias("n_models"), F.var_pop("score").alias("_v"))
    return g.withColumn("agreement", F.when(F.col("n_models") == 1, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.col("_v")))).drop("_v")


def exact_groups(docs: DataFrame) -> DataFrame:
    """key, keep, n: documents (id, text) of equal cleaned text, the smallest id to keep; null texts are left out."""
    k = docs.where("text is not null").select("id", F.md5(F.lower(F.regexp_replace(T.clean("text"), r"\s+", " "))).alias("key"))
    return k.groupBy("key").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))


def _grams(t: str) -> set:
    t = " ".join(t.lower().split())
    return {t[i : i + 3] for i in range(len(t) - 2)}


def _jac(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


def greedy_dedup(hits: DataFrame, limit: float = 0.9, shortest: int = 50) -> DataFrame:
    """Per query, in order of rank: a hit stays if its 3-gram Jaccard to every kept one is under ``limit`` and it has at
    least ``shortest`` characters (the first is exempt). Order-dependent, so a query's top-k list is one task."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        kept, out = [], []
        for qid, i, r, t in g.sort_values("rank")[["qid", "id", "rank", "text"]].itertuples(index=False):
            s = _grams(t)
            if not kept or (len(t) >= shortest and all(_jac(s, k) < limit for k in kept)):
                kept.append(s)
                out.append((qid, i, r))
        return pd.DataFrame(out, columns=["qid", "id", "rank"])

    return hits.groupBy("qid").applyInPandas(run, "qid bigint, id bigint, rank int")


def mmr(hits: DataFrame, k: int = 10, trade: float = LAMBDA) -> DataFrame:
    """Maximal marginal relevance: greedily the best of trade * score - (1 - trade) * highest word Jaccard to the selected."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "id"], ascending=[False, True])
        rows = [(i, s, set(t.lower().split())) for i, s, t in zip(g["id"], g["score"], g["text"])]
        sel: list = []
        while rows and len(sel) < k:
            b = max(range(len(rows)), key=lambda n: (trade * rows[n][1] - (1 - trade) * max((_jac(rows[n][2], s[2]) for s in sel), default=0.0), -n))
            sel.append(rows.pop(b))
        return pd.DataFrame({"qid": g["qid"].iloc[0], "id": [s[0] for s in sel], "pos": range(1, len(sel) + 1)})

    return hits.groupBy("qid").applyInPandas(run, "qid bigint, id bigint, pos int")


def best_threshold(scored: DataFrame, precision: float, steps: int = 50) -> DataFrame:
    """threshold, precision, recall: the lowest of ``steps`` thresholds with the wanted precision (scored: score, good)."""
    grid = scored.sparkSession.range(steps + 1).select((F.col("id") / steps).alias("threshold"))
    j = scored.join(F.broadcast(grid), F.col("score") >= F.col("threshold"))
    n = scored.agg(F.count_if("good").alias("_all"))
    g = j.groupBy("threshold").agg(F.avg(F.col("good").cast("int")).alias("precision"), F.count_if("good").alias("_g")).join(F.broadcast(n))
    g = g.select("threshold", "precision", F.try_divide("_g", "_all").alias("recall")).where(F.col("precision") >= precision)
    return g.orderBy("threshold").limit(1)
