"""Metrics of answers and of rankings. Answers: columns ``expected`` and ``generated``; rankings: qid, id, rank, relevant."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagraph.functions import text as T


def _multiset(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    n = lambda arr, w: F.size(F.filter(arr, lambda x: x == w))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, w: s + F.least(n(a, w), n(b, w)))


def token_f1(rows: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 of the words as multisets; 0 where a side is empty."""
    r = rows.withColumn("_g", T.words("generated")).withColumn("_e", T.words("expected")).withColumn("_i", _multiset(F.col("_e"), F.col("_g")))
    p, c = F.coalesce(F.try_divide("_i", F.size("_g")), F.lit(0.0)), F.coalesce(F.try_divide("_i", F.size("_e")), F.lit(0.0))
    r = r.withColumn("precision", p).withColumn("recall", c)
    return r.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))).drop("_g", "_e", "_i")


def bleu(rows: DataFrame, n: int) -> DataFrame:
    """Adds bleu: clipped n-gram overlap over the n-grams of the generated answer, no brevity penalty."""
    grams = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
    r = rows.withColumn("_w", T.words("generated")).withColumn("_v", T.words("expected")).withColumn("_g", grams(F.col("_w"))).withColumn("_e", grams(F.col("_v")))
    return r.withColumn("bleu", F.coalesce(F.try_divide(_multiset(F.col("_e"), F.col("_g")), F.size("_g")), F.lit(0.0))).drop("_w", "_v", "_g", "_e")


def match(rows: DataFrame) -> DataFrame:
    """Adds exact and contains: equality and substring of the texts in lower case, blanks collapsed."""
    n = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    e, g = n(F.col("expected")), n(F.col("generated"))
    return rows.withColumn("exact", (e == g) & (e != "")).withColumn("contains", F.contains(g, e) & (e != ""))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def rouge_l(rows: DataFrame) -> DataFrame:
    """Adds rouge_l, the F of the longest common subsequence of words; 0 where a side is empty."""

    @F.pandas_udf("double")
    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for e, g in it:
            out = []
            for x, y in zip(e, g):
                n = lcs(list(x), list(y))
                out.append(2 * n / (len(x) + len(y)) if n else 0.0)
            yield pd.Series(out)

    return rows.withColumn("rouge_l", run(T.words("expected"), T.words("generated")))


def faithfulness(rows: DataFrame, context: str = "expected") -> DataFrame:
    """Adds faithfulness: share of the answer's sentences over 10 characters with at least 70 % of their words in the context."""
    s = F.filter(F.split(F.coalesce("generated", F.lit("")), r"[.!?]+"), lambda x: F.length(F.trim(x)) > 10)
    c = T.words(context)
    r = rows.withColumn("_s", s).withColumn("_c", c)
    good = F.size(F.filter("_s", lambda x: T.overlap(F.array_distinct(T.words(x)), F.col("_c")) >= 0.7))
    return r.withColumn("faithfulness", F.coalesce(F.try_divide(good, F.size("_s")), F.lit(0.0))).drop("_s", "_c")


def number_recall(rows: DataFrame) -> DataFrame:
    """Adds number_recall: share of the expected answer's numbers that the generated one has; null if it has none."""
    n = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(T.NUMBER), F.lit(0)))
    return rows.withColumn("number_recall", F.when(F.size(n(F.col("expected"))) > 0, F.size(F.array_intersect(n(F.col("expected")), n(F.col("generated")))) / F.size(n(F.col("expected")))))


def keyword_accuracy(rows: DataFrame) -> DataFrame:
    """Adds keyword_accuracy: share of accepted keywords in the generated answer; null without keywords."""
    g = F.lower(F.coalesce("generated", F.lit("")))
    k = F.filter("accepted_keywords", lambda x: x.isNotNull())
    return rows.withColumn("keyword_accuracy", F.try_divide(F.size(F.filter(k, lambda x: F.contains(g, F.lower(x)))), F.when(F.size(k) > 0, F.size(k))))


def ranking(ranked: DataFrame, k: int, totals: DataFrame | None = None) -> DataFrame:
    """qid, ndcg, mrr, precision, ap at k of binary relevance; ideal gains from ``totals`` (qid, n) or the list itself.

    Queries without a relevant document have 0 throughout.
    """
    from pyspark.sql import Window

    r = ranked.where(F.col("rank") <= k).withColumn("_g", F.col("relevant").cast("int"))
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_h", F.sum("_g").over(w))
    g = r.groupBy("qid").agg(F.sum(F.col("_g") / F.log2(F.col("rank") + 1)).alias("dcg"), F.max(F.col("_g") / F.col("rank")).alias("mrr"), (F.sum("_g") / k).alias("precision"), F.sum(F.col("_g") * F.col("_h") / F.col("rank")).alias("_ap"), F.sum("_g").alias("_n"))
    g = g.join(totals.select("qid", F.col("n").alias("_all")), "qid", "left") if totals is not None else g.withColumn("_all", F.col("_n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.coalesce("_all", F.lit(0)).cast("int")))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return g.select("qid", (F.col("dcg") / ideal).alias("ndcg"), "mrr", "precision", F.coalesce(F.try_divide("_ap", F.least(F.lit(k), F.col("_all"))), F.lit(0.0)).alias("ap"))
