"""Scores and ladders: regimes, evidence, weights, validation, learning signals. All are column expressions or one groupBy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bands of a contribution (strong pro, weak pro, neutral high, neutral low, weak con, strong con).
BANDS = (0.7, 0.3, 0.3, -0.3, -0.3, -0.7)


def contribution(value: Column, direction: Column, bands=BANDS) -> Column:
    """1, .5, .2, 0, -.2, -.5 or -1 by the ladder of bands; the value counts negative where direction is 'negative'."""
    v = F.when(direction == "negative", -value).otherwise(value)
    c = F.when(v >= bands[0], 1.0)
    for b, x in zip(bands[1:], (0.5, 0.2, 0.0, -0.2, -0.5)):
        c = c.when(v >= b, x)
    return F.when(v.isNotNull(), c.otherwise(-1.0))


def condition(value: Column, op: Column, lo: Column, hi: Column) -> Column:
    """>, >=, <, <=, == (within 1e-9), between (inclusive); a missing value or an unknown operator is false."""
    c = F.when(op == ">", value > lo).when(op == ">=", value >= lo).when(op == "<", value < lo).when(op == "<=", value <= lo).when(op == "==", F.abs(value - lo) < 1e-9).when(op == "between", value.between(lo, hi))
    return F.coalesce(c, F.lit(False))


def regimes(values: DataFrame, specs: DataFrame) -> DataFrame:
    """Per entity the probability of each regime (share of its conditions that hold).

    values: entity, feature, value. specs: regime, priority, feature, op, lo, hi (a small table).
    """
    entities = values.select("entity").distinct()
    j = entities.join(F.broadcast(specs)).join(values, ["entity", "feature"], "left")
    ok = condition(F.col("value"), F.col("op"), F.col("lo"), F.col("hi"))
    return j.groupBy("entity", "regime", "priority").agg(F.avg(ok.cast("int")).alias("prob"), F.avg(F.col("value").isNull().cast("int")).alias("missing"))


def primary_regime(probs: DataFrame) -> DataFrame:
    """entity, regime, prob, uncertainty: the most probable regime (ties by priority, then name), null where none holds.

    uncertainty = .3 / (1 + 10 variance) [0 for one regime] + .4 missing share + .3 (1 - max), within 0..1.
    """
    best = F.max(F.struct("prob", "priority", "regime")).alias("_b")
    g = probs.groupBy("entity").agg(best, F.var_pop("prob").alias("_v"), F.count(F.lit(1)).alias("_n"), F.avg("missing").alias("_m"))
    u = F.when(F.col("_n") > 1, 0.3 / (1 + 10 * F.col("_v"))).otherwise(0.0) + 0.4 * F.col("_m") + 0.3 * (1 - F.col("_b.prob"))
    return g.select("entity", F.when(F.col("_b.prob") > 0, F.col("_b.regime")).alias("regime"), F.col("_b.prob").alias("prob"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), u)).alias("uncertainty"))


def fused_weight(conf: Column, decay: Column, sem: Column, n: Column, gold: Column, evidence: Column) -> Column:
    """Confidence less decay, times semantics, count and gold bonus, times the evidence factor (at least .1)."""
    w = conf * (1 - decay) * sem * (1 + F.least(F.lit(0.2), 0.02 * n)) * F.when(gold, 1.2).otherwise(1.0)
    return w * F.when(evidence != 1, F.greatest(F.lit(0.1), 0.5 * evidence + 0.5)).otherwise(1.0)


def decayed(conf: Column, days: Column) -> Column:
    """x .98 for every full 30 days."""
    return F.when(days >= 30, conf * F.pow(F.lit(0.98), F.floor(days / 30))).otherwise(conf)


def strength_band(x: Column) -> Column:
    return F.when(x < 0.1, "negligible").when(x < 0.25, "weak").when(x < 0.5, "moderate").when(x < 0.75, "strong").otherwise("very_strong")


def pcs(proximity: Column, semantic: Column, origin: Column, consistency: Column) -> tuple[Column, Column]:
    """Score (.25, .3, .2, .25, put to 0..1) and its label at .7 and .4."""
    s = (0.25 * proximity + 0.3 * semantic + 0.2 * origin + 0.25 * consistency + 1) / 2
    return s, F.when(s >= 0.7, "strong").when(s >= 0.4, "weak").otherwise("rejected")


def reward(hit: Column, conf: Column, drawdown: Column) -> Column:
    return hit.cast("int") - 0.5 * F.when(hit, 0.0).otherwise(conf) - 0.2 * F.abs(drawdown)


def scorecard(accuracy: Column, calibration_error: Column, coverage: Column, cost: Column, flags: Column) -> Column:
    """Weights .40, .20, .15, .10, .15 of accuracy, calibration, coverage, cost and cleanness."""
    return 0.4 * accuracy + 0.2 * F.greatest(F.lit(0.0), 1 - 2 * calibration_error) + 0.15 * coverage + 0.1 * (1 - cost / 50) + 0.15 * (1 - F.least(F.lit(1.0), 0.15 * flags))


def piecewise(value: Column, bad: Column, good: Column) -> Column:
    """0..100 between bad and good, either way round."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.try_divide(100 * (value - bad), good - bad)))


def grade(score: Column) -> Column:
    c = F.when(score >= 90, "A+")
    for b, g in ((80, "A"), (70, "B"), (60, "C"), (50, "D")):
        c = c.when(score >= b, g)
    return c.otherwise("F")


def confidence_route(student: Column, sign: Column, semantic: Column, rejected: Column) -> tuple[Column, Column]:
    """Score (.4, .3, .3) and destination: domain from .55, personal from .35, else or if rejected drop."""
    s = 0.4 * student + 0.3 * sign + 0.3 * semantic
    return s, F.when(rejected, "drop").when(s >= 0.55, "domain").when(s >= 0.35, "personal").otherwise("drop")


def schema_errors(rows: DataFrame, known: list[str]) -> DataFrame:
    """Edges (src, dst, rel) with ``errors``: an array of what is wrong, empty if nothing is."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    e = F.array_compact(F.array(F.when(blank("src"), "no_head"), F.when(blank("dst"), "no_tail"), F.when(~F.coalesce(F.col("rel").isin(known), F.lit(False)), "unknown_relation"), F.when(F.col("src") == F.col("dst"), "self_loop")))
    return rows.withColumn("errors", e)
