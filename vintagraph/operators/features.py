"""Features over irregular series: offsets, rolling windows, pairs of series.

All rolling windows are calendar windows [t - N days, t] with both ends included, over one value per (key, time).
``rolling`` cuts every key into blocks of several windows' length and lets each block also read the window before it,
so that a series that holds a third of all rows is many tasks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def rolling(points: DataFrame, days: float, exprs: dict[str, callable], key: str = "series_id", t: str = "t", factor: int = 4) -> DataFrame:
    """``points`` (key, t in micros, ...) with each of ``exprs``: name -> function of the window [t - days, t].

    A function gets the Spark window and returns a column. Rows with a null key or time are dropped.
    """
    width = int(days * DAY)
    span = max(width, DAY) * factor
    b = F.floor(F.col(t) / span)
    own = points.where(F.col(key).isNotNull() & F.col(t).isNotNull()).withColumn("_b", b)
    late = F.col(t) >= (F.col("_b") + 1) * span - width
    both = own.withColumn("_to", F.explode(F.when(late, F.array(F.col("_b"), F.col("_b") + 1)).otherwise(F.array(F.col("_b")))))
    w = Window.partitionBy(key, "_to").orderBy(t).rangeBetween(-width, Window.currentRow)
    for name, f in exprs.items():
        both = both.withColumn(name, f(w))
    return both.where("_to = _b").drop("_to", "_b")


def before(points: DataFrame, days: int, value: str = "value", key: str = "series_id", t: str = "t") -> DataFrame:
    """``points`` with ``prev``: the last value at or before t - days, however long ago.

    Found per block of ``days`` length or more, and through the last value of all earlier blocks.
    """
    width = days * DAY
    span = max(width, 30 * DAY) * 4
    p = points.withColumn("_b", F.floor(F.col(t) / span))
    shifted = p.select(key, (F.col(t) + width).alias("_at"), F.col(value).alias("_v")).withColumn("_b", F.floor(F.col("_at") / span))
    asks = p.select(key, F.col(t).alias("_at"), F.lit(None).cast("double").alias("_v"), "_b").withColumn("_ask", F.lit(1))
    both = shifted.withColumn("_ask", F.lit(0)).unionByName(asks)
    w = Window.partitionBy(key, "_b").orderBy("_at", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    in_block = both.withColumn("_in", F.last(F.when(F.col("_ask") == 0, F.struct("_v")), True).over(w)).where("_ask = 1")
    ends = shifted.groupBy(key, "_b").agg(F.max_by(F.struct("_v"), "_at").alias("_e"))
    blocks = ends.unionByName(asks.select(key, "_b", F.lit(None).cast("struct<_v:double>").alias("_e")).distinct()).groupBy(key, "_b").agg(F.max("_e").alias("_e"))
    carried = blocks.withColumn("_c", F.last("_e", True).over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select(key, "_b", "_c")
    found = in_block.join(carried, [key, "_b"], "left").select(key, F.col("_at").alias(t), F.coalesce("_in", "_c")["_v"].alias("prev"))
    return points.join(found, [key, t], "left")


def change(points: DataFrame, days: int, key: str = "series_id", t: str = "t") -> DataFrame:
    """Rate of change against the last value at or before t - days; no row where there is none or it is 0."""
    b = before(points, days, key=key, t=t)
    return b.withColumn("roc", F.try_divide(F.col("value") - F.col("prev"), F.col("prev"))).where("roc is not null").drop("prev")


def zscore(points: DataFrame, days: float) -> DataFrame:
    """(value - mean) / population deviation over the window, from 2 points; 0 where nothing varies."""
    r = rolling(points, days, {"_m": lambda w: F.avg("value").over(w), "_s": lambda w: F.stddev_pop("value").over(w), "_n": lambda w: F.count("value").over(w)})
    return r.where("_n >= 2").withColumn("z", F.coalesce(F.try_divide(F.col("value") - F.col("_m"), F.col("_s")), F.lit(0.0))).drop("_m", "_s", "_n")


def volatility(points: DataFrame, days: float, periods: int = 252) -> DataFrame:
    """Population deviation of simple one-step returns over the window times sqrt(periods), from 2 returns."""
    span = 8 * DAY
    p = points.withColumn("_b", F.floor(F.col("t") / span))
    ends = p.groupBy("series_id", "_b").agg(F.max_by("value", "t").alias("_e"))
    ends = ends.withColumn("_p", F.last("_e", True).over(Window.partitionBy("series_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_e")
    prev = F.coalesce(F.lag("value").over(Window.partitionBy("series_id", "_b").orderBy("t")), F.col("_p"))
    ret = p.join(ends, ["series_id", "_b"]).withColumn("ret", F.try_divide(F.col("value") - prev, prev)).where("ret is not null").drop("_b", "_p")
    r = rolling(ret, days, {"_s": lambda w: F.stddev_pop("ret").over(w), "_n": lambda w: F.count("ret").over(w)})
    return r.where("_n >= 2").withColumn("volatility", F.col("_s") * F.sqrt(F.lit(float(periods)))).drop("_s", "_n", "ret")


def percentile(points: DataFrame, days: float, factor: int = 4) -> DataFrame:
    """``points`` (series_id, t, value) with pct: the share of the window's values that are at most the current one.

    A sorted window slides over each block, so a row costs a search and not a pass over its window.
    """
    width = int(days * DAY)
    span = max(width, DAY) * factor
    own = points.where("series_id is not null and t is not null and value is not null").withColumn("_b", F.floor(F.col("t") / span))
    late = F.col("t") >= (F.col("_b") + 1) * span - width
    both = own.withColumn("_to", F.explode(F.when(late, F.array(F.col("_b"), F.col("_b") + 1)).otherwise(F.array("_b"))))

    names = [*points.columns, "pct"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t", kind="stable")
        t, v, mine = g["t"].to_numpy(), g["value"].to_numpy(), (g["_b"] == g["_to"]).to_numpy()
        held, first, last, pct = [], 0, 0, np.empty(len(g))
        for i in range(len(g)):
            while last < len(g) and t[last] <= t[i]:
                insort(held, v[last])
                last += 1
            while t[first] < t[i] - width:
                del held[bisect_left(held, v[first])]
                first += 1
            pct[i] = bisect_right(held, v[i]) / len(held)
        return g.assign(pct=pct)[mine][names]

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    return both.groupBy("series_id", "_to").applyInPandas(run, kinds + ", pct double")


def compute(points: DataFrame, specs: DataFrame) -> DataFrame:
    """feature_id, t, value of every feature of ``specs`` (feature_id, feature_type, input_series, window_days) over
    ``points`` (series_id, t, value): raw, roc, zscore, percentile and spread; other types, and types with a window that name none, give no rows.

    Features of one type and window are worked out together; the spec table is configuration.
    """
    sp = specs.where("feature_id is not null").select("feature_id", "feature_type", "window_days", F.try_element_at("input_series", F.lit(1)).alias("a"), F.try_element_at("input_series", F.lit(2)).alias("b")).distinct()
    out = points.select(F.lit(None).cast("string").alias("feature_id"), "t", F.col("value").cast("double").alias("value")).where("false")
    for kind, days in sorted((r[0], -1 if r[1] is None else r[1]) for r in sp.select("feature_type", "window_days").distinct().collect() if r[0] is not None):
        days = None if days < 0 else days
        mine = F.broadcast(sp.where((F.col("feature_type") == kind) & F.col("window_days").eqNullSafe(F.lit(days))))  # specs are configuration
        if kind == "spread":
            p = paired(points, mine.select(F.col("feature_id").alias("pair"), "a", "b"))
            out = out.unionByName(spread(p).select(F.col("pair").alias("feature_id"), "t", F.col("spread").alias("value")))
            continue
        p = points.join(mine.select(F.col("a").alias("series_id"), "feature_id"), "series_id").select(F.col("feature_id").alias("series_id"), "t", "value")
        made = {"raw": lambda: p, "roc": lambda: change(p, days).select("series_id", "t", F.col("roc").alias("value")), "zscore": lambda: zscore(p, days).select("series_id", "t", F.col("z").alias("value")), "percentile": lambda: percentile(p, days).select("series_id", "t", F.col("pct").alias("value"))}
        if kind in made and (kind == "raw" or days is not None):
            out = out.unionByName(made[kind]().withColumnRenamed("series_id", "feature_id"))
    return out


def paired(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair, t, x, y: values of both series of each pair (pair, a, b) at equal times."""
    x = points.join(pairs.select("pair", F.col("a").alias("series_id"), "b"), "series_id").select("pair", "b", "t", F.col("value").alias("x"))
    y = points.select(F.col("series_id").alias("b"), "t", F.col("value").alias("y"))
    return x.join(y, ["b", "t"]).select("pair", "t", "x", "y")


def spread(pairs: DataFrame, scale: float = 1.0) -> DataFrame:
    return pairs.select("pair", "t", ((F.col("x") - F.col("y")) * scale).alias("spread"))


def ratio(pairs: DataFrame) -> DataFrame:
    """x / y; no row where y is 0 or null."""
    return pairs.select("pair", "t", F.try_divide("x", "y").alias("ratio")).where("ratio is not null")


def correlation(pairs: DataFrame, days: float) -> DataFrame:
    """Population correlation of x and y over the window, from 3 common points; no row where one does not vary.

    Built from moments: the engine's own corr fails on constant input.
    """
    m = {"_n": lambda w: F.count("x").over(w), "_xy": lambda w: F.covar_pop("x", "y").over(w), "_sx": lambda w: F.stddev_pop("x").over(w), "_sy": lambda w: F.stddev_pop("y").over(w)}
    r = rolling(pairs, days, m, key="pair").where("_n >= 3 and _sx > 1e-12 and _sy > 1e-12")
    return r.select("pair", "t", (F.col("_xy") / (F.col("_sx") * F.col("_sy"))).alias("corr"))


def deltas(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Relative changes between two versions: |change| >= 0.2 HIGH, >= 0.1 MEDIUM; others, 0 and missing are left out."""
    j = old.select(*keys, F.col(value).alias("_o")).join(new.select(*keys, F.col(value).alias("_n")), keys)
    j = j.withColumn("pct", F.try_divide(F.col("_n") - F.col("_o"), F.abs("_o")))
    return j.where(F.abs("pct") >= 0.1).select(*keys, "pct", F.when(F.abs("pct") >= 0.2, "HIGH").otherwise("MEDIUM").alias("severity"))


def affected(specs: DataFrame, changed: DataFrame, feature: str, inputs: str) -> DataFrame:
    """The features that read a changed series (``changed``: series_id)."""
    return specs.select(feature, F.explode(inputs).alias("series_id")).join(changed.select("series_id").distinct(), "series_id", "left_semi").select(feature).distinct()


