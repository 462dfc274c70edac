"""Checks and choices of retrieved contexts and answers: relevance, filters, reranking, selection, unsupported claims."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagraph.functions import text as T


def found(text: Column, terms: list[str]) -> Column:
    """How many of the terms a text contains, case disregarded."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(t, F.lit(w.lower())).cast("int") for w in terms), F.lit(0))


def relevance(query: Column, text: Column, patterns: list[str], weight: Column | float = 1.0) -> Column:
    """Share of the query's words in the text, weighted, + .05 per pattern that occurs + .1 for a measurement, at most 1."""
    share = T.overlap(F.array_distinct(T.words(query)), T.words(text))
    hits = sum((F.coalesce(text, F.lit("")).rlike(p).cast("int") for p in patterns), F.lit(0))
    return F.least(F.lit(1.0), share * weight + 0.05 * hits + F.when(F.size(T.measurements(text)) > 0, 0.1).otherwise(0.0))


def keep_best(scored: DataFrame, most: Column | int, least: float | None = None) -> DataFrame:
    """Of each query (qid, id, score) the best ``most`` of at least ``least``; the best one stays anyway. Ties to the smaller id."""
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "id")
    r = scored.withColumn("pos", F.row_number().over(w))
    ok = F.col("pos") <= most
    return r.where((F.col("pos") == 1) | (ok if least is None else ok & (F.col("score") >= least)))


def adaptive(query: Column, most: int = 5) -> Column:
    """2 contexts for questions of at most 3 words, 3 for at most 6, else ``most``."""
    n = F.size(T.words(query))
    return F.when(n <= 3, 2).when(n <= 6, 3).otherwise(most)


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


def select_diverse(scored: DataFrame, k: int = 5, trade: float = 0.7, distinct: float = 0.0) -> DataFrame:
    """qid, id, pos: greedily the best of trade * score + (1 - trade) * (1 - highest word Jaccard to the selected).

    Contexts whose difference to a selected one is under ``distinct`` are passed over. Order-dependent, so a query's list
    of candidates (qid, id, score, text) is one task. Ties to the smaller id; null texts have no words.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        rows = [(i, s, set((t or "").lower().split())) for i, s, t in zip(g["id"], g["score"], g["text"])]
        sel: list = []
        while rows and len(sel) < k:
            near = [max((_jaccard(r[2], s[2]) for s in sel), default=0.0) for r in rows]
            best = max(range(len(rows)), key=lambda n: (round(trade * rows[n][1] + (1 - trade) * (1 - near[n]), 9), -n))
            row = rows.pop(best)
            if not sel or 1 - near[best] >= distinct:
                sel.append(row)
        return pd.DataFrame({"qid": g["qid"].iloc[0], "id": [s[0] for s in sel], "pos": range(1, len(sel) + 1)})

    return scored.select("qid", "id", "score", "text").groupBy("qid").applyInPandas(run, "qid bigint, id bigint, pos int")


def domain_score(base: Column, text: Column, domain: list[str], process: list[str], temperature: float = 1.0, bias: float = 0.0) -> Column:
    """.25 base + .3 share of domain terms + .2 process terms (of 10) + .25 measurements (of 5), calibrated."""
    technical = F.least(F.lit(1.0), F.size(T.measurements(text)) / 5)
    x = 0.25 * base + 0.3 * found(text, domain) / max(1, len(domain)) + 0.2 * F.least(F.lit(1.0), found(text, process) / 10) + 0.25 * technical
    return T.calibrate(x, temperature, bias)


def unsupported(rows: DataFrame, speculation: list[str], general: list[str]) -> DataFrame:
    """Adds what speaks against an answer (question, context, answer): ``signs`` (sorted names), ``weight`` (their sum) and
    ``flagged`` (some sign, and more than .5).

    general .8, speculation .6, a sentence of over 10 characters with under .2 of its words in the context .7, a number
    with a unit that the context lacks .9, under .3 of the answer's words in the context .5, under .4 of the question's
    words in the answer .4. Null answers have no sign.
    """
    a, c, q = F.coalesce("answer", F.lit("")), F.coalesce("context", F.lit("")), F.coalesce("question", F.lit(""))
    aw, cw, qw = F.array_distinct(T.words(a)), F.array_distinct(T.words(c)), F.array_distinct(T.words(q))
    r = rows.withColumn("_cw", cw).withColumn("_m", T.measurements(c))
    s = F.filter(F.split(a, r"(?<=[.!?])\s+"), lambda x: F.length(F.trim(x)) > 10)
    loose = F.exists(s, lambda x: T.overlap(F.array_distinct(T.words(x)), F.col("_cw")) < 0.2)
    new = F.size(F.array_except(T.measurements(a), F.col("_m"))) > 0
    said = a != ""
    signs = {"general": (0.8, found(a, general) > 0), "speculation": (0.6, found(a, speculation) > 0), "sentence": (0.7, loose), "number": (0.9, new), "document": (0.5, T.overlap(aw, F.col("_cw")) < 0.3), "question": (0.4, T.overlap(qw, aw) < 0.4)}
    names = F.array_compact(F.array(*[F.when(said & cond, F.lit(n)) for n, (_, cond) in sorted(signs.items())]))
    weights = {n: w for n, (w, _) in signs.items()}
    r = r.withColumn("signs", names)
    total = sum((F.when(F.array_contains("signs", n), w).otherwise(0.0) for n, w in sorted(weights.items())), F.lit(0.0))
    return r.withColumn("weight", total).withColumn("flagged", F.col("weight") > 0.5).drop("_cw", "_m")


def context_precision(hits: DataFrame, least: float = 0.3) -> DataFrame:
    """qid, precision, coverage, first: share of contexts with at least ``least`` of the query's words, share of the query's
    words in all contexts, and whether the first context is relevant; overall = .4, .4, .2."""
    share = T.overlap(F.array_distinct(T.words("query")), T.words("text"))
    h = hits.withColumn("_s", share)
    w = F.size(F.array_distinct(F.flatten(F.collect_set(F.array_intersect(F.array_distinct(T.words("query")), T.words("text"))))))
    g = h.groupBy("qid").agg(F.avg((F.col("_s") >= least).cast("int")).alias("precision"), F.try_divide(w, F.max(F.size(F.array_distinct(T.words("query"))))).alias("coverage"), F.max(F.when(F.col("rank") == 1, (F.col("_s") >= least).cast("int"))).alias("first"))
    return g.withColumn("overall", 0.4 * F.col("precision") + 0.4 * F.coalesce("coverage", F.lit(0.0)) + 0.2 * F.coalesce("first", F.lit(0)))


def at_k(ranked: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """qid, recall, f1, hit1, hit3, hit5 of rankings (qid, rank, relevant) against the number of relevant ones (qid, n)."""
    r = ranked.where(F.col("rank") <= k)
    g = r.groupBy("qid").agg(F.count_if("relevant").alias("_h"), *[F.coalesce(F.max(F.when((F.col("rank") <= n) & F.col("relevant"), 1)), F.lit(0)).alias(f"hit{n}") for n in (1, 3, 5)])
    j = g.join(totals.select("qid", F.col("n").alias("_n")), "qid", "left")
    recall, precision = F.coalesce(F.try_divide("_h", "_n"), F.lit(0.0)), F.col("_h") / k
    return j.select("qid", recall.alias("recall"), F.coalesce(F.try_divide(2 * recall * precision, recall + precision), F.lit(0.0)).alias("f1"), "hit1", "hit3", "hit5")
