"""Validation, fusion and state of knowledge-graph edges and of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sign_votes(votes: list[Column]) -> tuple[Column, Column]:
    """(sign, score) of votes '+', '-' or null: all that vote agree .9, majority .6, tie or none unknown 0."""
    a = F.filter(F.array(*votes), lambda x: x.isNotNull())
    p, n = F.size(F.filter(a, lambda x: x == "+")), F.size(F.filter(a, lambda x: x == "-"))
    sign = F.when(p > n, "+").when(n > p, "-")
    score = F.when(sign.isNull(), 0.0).when((p == 0) | (n == 0), 0.9).otherwise(0.6)
    return sign, score


def semantic_tag(text: Column, relation: Column, strong: list[str], correlates: list[str], weak: list[str]) -> tuple[Column, Column]:
    """(tag, confidence): exaggeration, correlation taken for cause (only of causes), weak evidence, else plausible."""
    t = F.lower(F.coalesce(text, F.lit("")))
    has = lambda ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(t, w))
    tag = F.when(has(strong), "exaggeration").when(has(correlates) & (relation == "cause"), "correlation").when(has(weak), "weak").otherwise("plausible")
    return tag, F.when(tag == "plausible", 0.8).when(tag == "weak", 0.5).otherwise(0.3)


def static_guard(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """edges (src, dst, sign) with ``decision`` by rules (src, dst, rule_sign): none create, same strengthen, other reject (an unknown sign strengthens)."""
    j = edges.join(rules, ["src", "dst"], "left")
    d = F.when(F.col("rule_sign").isNull(), "create").when(F.col("sign").isNull() | (F.col("sign") == 0) | (F.col("sign") == F.col("rule_sign")), "strengthen").otherwise("reject")
    return j.withColumn("decision", d)


def spec_match(edges: DataFrame, specs: DataFrame) -> DataFrame:
    """Best specification of each edge (id, head, tail, rel): share of the checks a spec makes that hold; ties to the smaller ord.

    specs (a small table): ord, name, head_has, tail_has (arrays), rel; null parts make no check. No spec fits: null.
    """
    e = edges.join(F.broadcast(specs.withColumnRenamed("rel", "s_rel")))
    has = lambda words, c: F.exists(words, lambda w: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(w)))
    checks = [F.when(F.col("head_has").isNotNull(), has(F.col("head_has"), F.col("head"))), F.when(F.col("tail_has").isNotNull(), has(F.col("tail_has"), F.col("tail"))), F.when(F.col("s_rel").isNotNull(), F.lower("s_rel") == F.lower("rel"))]
    n = sum((c.isNotNull().cast("int") for c in checks), F.lit(0))
    hit = sum((F.coalesce(c, F.lit(False)).cast("int") for c in checks), F.lit(0))
    s = e.withColumn("score", F.try_divide(hit, n)).where("score > 0")
    best = s.groupBy("id").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"), "name")).alias("b"))
    return edges.join(best, "id", "left").select("id", F.col("b.name").alias("spec"), F.col("b.score").alias("score"))


def conflicts(edges: DataFrame) -> DataFrame:
    """Pairs with edges of both signs: sums of evidence, which side prevails (3 to 1) and what to do with the other.

    edges: src, dst, sign, conf, n.
    """
    side = lambda s, c: F.sum(F.when(F.col("sign") == s, F.col(c)).otherwise(0))
    g = edges.groupBy("src", "dst").agg(side(1, "n").alias("pos_n"), side(-1, "n").alias("neg_n"), F.count_if(F.col("sign") == 1).alias("_p"), F.count_if(F.col("sign") == -1).alias("_m"), F.min("conf").alias("least"))
    act = F.when(F.greatest("pos_n", "neg_n") >= 3 * F.least("pos_n", "neg_n"), "personal").when(F.col("least") < 0.4, "drift").otherwise("keep")
    return g.where("_p > 0 and _m > 0").select("src", "dst", "pos_n", "neg_n", act.alias("action"))


def gap(personal: DataFrame, domain: DataFrame, keys: list[str]) -> DataFrame:
    """Personal edges against the domain: 'missing', 'same' or 'opposite' sign."""
    j = personal.join(domain.select(*keys, F.col("sign").alias("_d")).distinct(), keys, "left")
    return j.withColumn("case", F.when(F.col("_d").isNull(), "missing").when(F.col("_d") == F.col("sign"), "same").otherwise("opposite")).drop("_d")


def best_lag(scores: DataFrame, key: str, lag: str, score: str) -> DataFrame:
    """Of each key the lag of greatest |score|, the smaller one of equals."""
    b = F.max(F.struct(F.abs(score).alias("a"), (-F.col(lag)).alias("l"), F.col(score).alias("s"))).alias("b")
    return scores.groupBy(key).agg(b).select(key, (-F.col("b.l")).alias(lag), F.col("b.s").alias(score))


def impact(effects: DataFrame, key: str, x: str) -> DataFrame:
    """Sums of positive and negative effects and the verdict: + or - where one is more than 1.2 times the other, else mixed."""
    g = effects.groupBy(key).agg(F.sum(F.when(F.col(x) > 0, F.col(x)).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(x) < 0, -F.col(x)).otherwise(0.0)).alias("neg"))
    return g.withColumn("verdict", F.when(F.col("pos") > 1.2 * F.col("neg"), "+").when(F.col("neg") > 1.2 * F.col("pos"), "-").otherwise("mixed"))


def confidence_machine(events: DataFrame, key: list[str], order: list[str], plus: str) -> DataFrame:
    """Confidence of each key after its events: +.05 / sqrt(n) up to .95 for support, -.08 down to .1 otherwise, from .5.

    Clamping at every step makes the order matter, so it is a fold over the sorted events of a key.
    """
    s = F.array_sort(F.collect_list(F.struct(*order, F.col(plus).alias("_p"))))
    init = F.struct(F.lit(0.5).alias("c"), F.lit(0).alias("n"))
    step = lambda a, e: F.struct(F.when(e["_p"], F.least(F.lit(0.95), a["c"] + 0.05 / F.sqrt((a["n"] + 1).cast("double")))).otherwise(F.greatest(F.lit(0.1), a["c"] - 0.08)).alias("c"), (a["n"] + 1).alias("n"))
    return events.groupBy(*key).agg(s.alias("_s")).select(*key, F.aggregate("_s", init, step).alias("_f")).select(*key, F.col("_f.c").alias("confidence"), F.col("_f.n").alias("n"))


def consistency(rows: DataFrame, part: list[str], pattern: str, order: str) -> DataFrame:
    """Share of earlier rows with the same pattern, doubled, at most .8; 0 for the first."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    wp = Window.partitionBy(*part, pattern).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("consistency", F.coalesce(F.least(F.lit(0.8), 2 * F.try_divide(F.count(F.lit(1)).over(wp), F.count(F.lit(1)).over(w))), F.lit(0.0)))


def grid_search(samples: DataFrame, thresholds: list[float], score: str, good: str) -> DataFrame:
    """threshold, reward: mean of +1 for a hit taken, -1 for a miss taken, 0 for one left, for every threshold at once."""
    t = F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold")
    r = F.when(F.col(score) < F.col("threshold"), 0).when(F.col(good), 1).otherwise(-1)
    return samples.select(score, good, t).groupBy("threshold").agg(F.avg(r).alias("reward"))


def rolling_policy(samples: DataFrame, step: str, score: str, good: str, start: float = 0.5, move: float = 0.05, lo: float = 0.2, hi: float = 0.9) -> DataFrame:
    """step, threshold, n, reward, next: a replay in which every step takes the samples of at least the threshold, earns +1
    for a good one and -1 for another, and lowers the threshold after a gain, raises it after a loss, within lo..hi.

    Scores count in twentieths, so a step is one short histogram however many samples it has; steps are folded in order.
    Null scores and steps are left out. Thresholds are whole multiples of ``move``.
    """
    cell = F.floor(F.col(score) / move + 1e-9).cast("int")
    h = samples.where(F.col(score).isNotNull() & F.col(step).isNotNull()).groupBy(step, cell.alias("_c")).agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("g"))
    rows = h.groupBy(step).agg(F.collect_list(F.struct("_c", "n", "g")).alias("_h"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(step).alias("step"), "_h"))).alias("_s"))  # one entry a step
    a, b = round(lo / move), round(hi / move)
    empty = F.array().cast("array<struct<step:string,t:int,n:bigint,r:bigint,u:int>>")

    def fold(acc: Column, x: Column) -> Column:
        t = acc["t"]
        taken = F.filter(x["_h"], lambda c: c["_c"] >= t)
        n = F.aggregate(taken, F.lit(0).cast("bigint"), lambda s, c: s + c["n"])
        r = F.aggregate(taken, F.lit(0).cast("bigint"), lambda s, c: s + 2 * c["g"] - c["n"])
        u = F.when(r > 0, F.greatest(F.lit(a), t - 1)).when(r < 0, F.least(F.lit(b), t + 1)).otherwise(t)
        row = F.struct(x["step"].cast("string").alias("step"), t.alias("t"), n.alias("n"), r.alias("r"), u.alias("u"))
        return F.struct(u.alias("t"), F.concat(acc["o"], F.array(row)).alias("o"))

    out = one.select(F.explode_outer(F.aggregate("_s", F.struct(F.lit(round(start / move)).alias("t"), empty.alias("o")), fold)["o"]).alias("x")).where("x is not null")
    return out.select("x.step", (F.col("x.t") * move).alias("threshold"), "x.n", F.col("x.r").alias("reward"), (F.col("x.u") * move).alias("next"))
