"""Checks of answers, hits and edges as column expressions or one groupBy; a few greedy ones per query."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagraph.functions import text as T
from vintagraph.operators.bitemporal import safe


def drift_signal(conflict_share: Column, n: Column, is_decayed: Column, tag: Column) -> Column:
    """.3 conflict share (from 5 observations) + .25 share + .25 half if decayed + .2 by tag; a drift from .6."""
    by_tag = F.when(tag == "ambiguous", 0.8).when(tag == "weak", 0.5).otherwise(0.0)
    return F.when(n >= 5, 0.3 * conflict_share).otherwise(0.0) + 0.25 * conflict_share + 0.25 * F.when(is_decayed, 0.5).otherwise(0.0) + 0.2 * by_tag


def promotion_signal(pcs: Column, n: Column, gap: Column, days: Column) -> Column:
    """.3 PCS + .3 count ladder (10, 5, 3) + .2 gap + .2 span of time (up to 90 days)."""
    ladder = F.when(n >= 10, 1.0).when(n >= 5, 0.8).when(n >= 3, 0.6).otherwise(0.2)
    return 0.3 * pcs + 0.3 * ladder + 0.2 * gap + 0.2 * F.least(F.lit(1.0), days / 90.0)


def correctness(rows: DataFrame) -> DataFrame:
    """Adds correctness: .4 word recall + .6 (.5 numbers + .3 units + .2 word recall); what the expected answer lacks counts 1."""
    share = lambda a, b: F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(1.0)
    num = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(T.NUMBER), F.lit(0)))
    unit = lambda c: F.array_distinct(F.transform(T.measurements(c), T.measured_unit))
    word = lambda c: F.array_distinct(T.words(c))
    r = share(word("expected"), word("generated"))
    n, u = share(num(F.col("expected")), num(F.col("generated"))), share(unit("expected"), unit("generated"))
    return rows.withColumn("correctness", 0.4 * r + 0.6 * (0.5 * n + 0.3 * u + 0.2 * r))


def similarity(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adds similarity (Ratcliff-Obershelp) of two text columns; 0 where one is null."""

    @F.pandas_udf("double")
    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in it:
            yield pd.Series([difflib.SequenceMatcher(None, p, q, autojunk=False).ratio() if p is not None and q is not None else 0.0 for p, q in zip(x, y)])

    return rows.withColumn("similarity", run(a, b))


def result_issues(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, issues (array), accurate: of ranked hits (qid, score in 0..1): few (< 3), low (mean < .3), flat (variance < .01)."""
    g = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("m"), F.var_pop("score").alias("v"))
    j = queries.select("qid").join(g, "qid", "left").fillna(0, ["n", "m", "v"])
    issues = F.array_compact(F.array(F.when(F.col("n") < 3, "few"), F.when(F.col("m") < 0.3, "low"), F.when(F.col("v") < 0.01, "flat")))
    return j.select("qid", issues.alias("issues"), ((F.col("m") >= 0.7) & (F.size(issues) == 0)).alias("accurate"))


def numeric_boost(hits: DataFrame, near: float = 0.05) -> DataFrame:
    """Adds boost: +.2 if the text has a number of the query, else .15 / (1 + d) for the nearest one within 100; 0 without numbers."""
    num = lambda c: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(T.NUMBER), F.lit(0)), lambda x: F.regexp_replace(x, ",", "").cast("double"))
    h = hits.withColumn("_q", num(F.col("query"))).withColumn("_t", F.array_distinct(num(F.col("text"))))
    d = F.array_min(F.flatten(F.transform("_q", lambda x: F.transform("_t", lambda y: F.abs(x - y)))))
    return h.withColumn("_d", d).withColumn("boost", F.when(F.col("_d") == 0, 0.2).when(F.col("_d") <= 100, 0.15 / (1 + F.col("_d"))).otherwise(0.0)).drop("_q", "_t", "_d")


def resolve(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """How each distinct reference (ref) is resolved: exact id .95, normalised id .9, same letters and digits .85, else new .5."""
    norm = lambda c: F.lower(F.trim(c))
    bare = lambda c: F.regexp_replace(norm(c), r"[^\p{L}\p{N}]", "")
    e = entities.select("id").where("id is not null").distinct()
    exact = e.select(F.col("id").alias("ref"), F.col("id").alias("by_id"))
    n = e.groupBy(norm(F.col("id")).alias("_n")).agg(F.min("id").alias("by_norm"))
    b = e.groupBy(bare(F.col("id")).alias("_b")).agg(F.min("id").alias("by_bare"))
    r = refs.select("ref").where("ref is not null").distinct().withColumn("_n", norm(F.col("ref"))).withColumn("_b", bare(F.col("ref")))
    j = r.join(exact, "ref", "left").join(n, "_n", "left").join(b, "_b", "left")
    conf = F.when(F.col("by_id").isNotNull(), 0.95).when(F.col("by_norm").isNotNull(), 0.9).when(F.col("by_bare").isNotNull(), 0.85).otherwise(0.5)
    return j.select("ref", F.coalesce("by_id", "by_norm", "by_bare").alias("entity"), conf.alias("confidence"))


def similar_names(refs: DataFrame, names: DataFrame, least: float = 0.6) -> DataFrame:
    """ref, entity, similarity: of every reference the name with most in common, by the Jaccard of character 3-grams.

    Both sides meet on shared grams, so only names with something in common are compared; a name's grams are counted,
    not joined again. Ties to the smaller entity. ``refs``: ref; ``names``: entity, name. Texts under three characters
    have themselves as gram.
    """
    grams = lambda c: F.array_distinct(F.when(F.length(c) > 3, F.regexp_extract_all(c, F.lit("(?=(.{3}))"), F.lit(1))).otherwise(F.array(c)))
    side = lambda df, key, c: df.where(F.length(F.trim(c)) > 0).select(key, grams(F.lower(F.trim(c))).alias("_g")).distinct()
    r, n = side(refs, "ref", F.col("ref")), side(names, "entity", F.col("name"))
    e = lambda df, key, size: df.select(key, F.size("_g").alias(size), F.explode_outer("_g").alias("g"))
    j = e(r, "ref", "_a").join(e(n, "entity", "_b"), "g").groupBy("ref", "entity", "_a", "_b").agg(F.count(F.lit(1)).alias("_k"))
    s = j.select("ref", "entity", (F.col("_k") / (F.col("_a") + F.col("_b") - F.col("_k"))).alias("similarity")).where(F.col("similarity") >= least)
    best = s.groupBy("ref").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "entity")).alias("b"))
    return best.select("ref", F.col("b.entity").alias("entity"), (-F.col("b.s")).alias("similarity"))


def metadata_filter(rows: DataFrame, title: str, time: str, text: str, title_has: list[str] | None = None, since: str | None = None, patterns: list[str] | None = None) -> DataFrame:
    """Rows whose title contains one of the words, whose date (a null one passes) is not before ``since``, and whose text
    has one of the patterns; parts not given make no check, null texts match nothing."""
    r = rows
    if title_has:
        t = F.lower(F.coalesce(title, F.lit("")))
        r = r.where(F.exists(F.array(*[F.lit(w.lower()) for w in title_has]), lambda w: F.contains(t, w)))
    if since:
        r = r.where(F.col(time).isNull() | (F.col(time) >= F.lit(since).cast("date")))
    return r.where(F.lower(text).rlike("|".join(f"(?:{p})" for p in patterns))) if patterns else r


def replay(rows: DataFrame, steps: DataFrame, key: str = "series_id", t: str = "timestamp", known: str = "as_of", value: str = "value") -> DataFrame:
    """step, key, value: what a replay would read as the last value at every step, all steps at once; NaN comes out as null.

    ``steps`` (step) is a calendar, sent along as one array. A version counts from its first step on; the best so far
    runs along the steps, so rows are never copied to steps.
    """
    calendar = steps.where("step is not null").agg(F.array_sort(F.collect_set("step")).alias("_c"))
    own = rows.where(F.col(known).isNotNull()).crossJoin(F.broadcast(calendar)).withColumn("step", F.try_element_at(F.filter("_c", lambda x: x >= F.col(known)), F.lit(1))).where("step is not null")  # one row
    own = own.groupBy(key, "step").agg(F.max(F.struct(t, known, value)).alias("b"))
    grid = rows.select(key).distinct().crossJoin(F.broadcast(calendar)).select(key, F.explode_outer("_c").alias("step"))  # one row
    run = F.max("b").over(Window.partitionBy(key).orderBy("step"))
    held = F.col(f"b.{value}")
    held = safe(held) if rows.schema[value].dataType.typeName() in ("double", "float") else held
    return grid.join(own, [key, "step"], "left").withColumn("b", run).where("b is not null").select("step", key, held.alias(value))
