"""Pairs of instruments: returns, spreads, momentum, half-life, drawdown, a position machine.

Prices are long (dt, ticker, close); frames are never pivoted. Row-count windows need a total order per ticker, so
they run per ticker: a ticker's rows are its trading days, which the calendar bounds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LN2 = 0.6931471805599453


def _by(key: str, order: str) -> Window:
    return Window.partitionBy(key).orderBy(order)


def fill_forward(prices: DataFrame) -> DataFrame:
    """Every ticker on every date that has any price, with its last close; dates before its first stay out."""
    grid = prices.where("close is not null").select("dt").distinct().join(prices.select("ticker").distinct())
    full = grid.join(prices, ["dt", "ticker"], "left")
    w = _by("ticker", "dt").rowsBetween(Window.unboundedPreceding, 0)
    return full.withColumn("close", F.last("close", True).over(w)).where("close is not null")


def log_returns(prices: DataFrame) -> DataFrame:
    """ln(p / previous p) per ticker, on dates where every ticker has one."""
    r = prices.withColumn("r", F.when((F.col("close") > 0) & (F.lag("close").over(_by("ticker", "dt")) > 0), F.log(F.col("close") / F.lag("close").over(_by("ticker", "dt"))))).where("r is not null").select("dt", "ticker", "r")
    n = prices.select("ticker").distinct().agg(F.count(F.lit(1)).alias("_all"))
    whole = r.groupBy("dt").agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(n), F.col("_n") == F.col("_all")).select("dt")
    return r.join(whole, "dt", "left_semi")


def momentum(returns: DataFrame, n: int) -> DataFrame:
    """exp(sum of the last n log returns) - 1 per ticker; null with fewer than n."""
    w = Window.partitionBy("ticker").orderBy(F.col("dt").desc())
    last = returns.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    return last.groupBy("ticker").agg(F.when(F.count("r") >= n, F.exp(F.sum("r")) - 1).alias("momentum"))


def pairs_within(groups: DataFrame) -> DataFrame:
    """All pairs a < b of the tickers of a sector (groups: sector, ticker), as ordered ids."""
    a = groups.select("sector", F.col("ticker").alias("a"))
    b = groups.select("sector", F.col("ticker").alias("b"))
    return a.join(b, "sector").where("a < b")


def two(values: DataFrame, pairs: DataFrame, value: str) -> DataFrame:
    """a, b, dt, x, y for each pair and common date."""
    x = pairs.select("a", "b").join(values.select(F.col("ticker").alias("a"), "dt", F.col(value).alias("x")), "a")
    return x.join(values.select(F.col("ticker").alias("b"), "dt", F.col(value).alias("y")), ["b", "dt"])


def rolling_corr_mean(xy: DataFrame, rows: int) -> DataFrame:
    """Mean over time of the correlation of the last ``rows`` rows, full windows only, per pair."""
    w = Window.partitionBy("a", "b").orderBy("dt").rowsBetween(-(rows - 1), 0)
    r = xy.withColumn("_n", F.count("x").over(w)).withColumn("_c", F.try_divide(F.covar_pop("x", "y").over(w), F.stddev_pop("x").over(w) * F.stddev_pop("y").over(w)))
    return r.where(F.col("_n") == rows).groupBy("a", "b").agg(F.avg("_c").alias("mean_corr"))


def spread_z(xy: DataFrame, rows: int = 63) -> DataFrame:
    """ln(x / y), its z over the last ``rows`` rows (sample deviation, full windows) and the signal at 1.5 and 1.0."""
    w = Window.partitionBy("a", "b").orderBy("dt").rowsBetween(-(rows - 1), 0)
    s = xy.where("x > 0 and y > 0").withColumn("spread", F.log(F.col("x") / F.col("y")))
    z = s.withColumn("_n", F.count("spread").over(w)).withColumn("z", F.try_divide(F.col("spread") - F.avg("spread").over(w), F.stddev_samp("spread").over(w))).where(F.col("_n") == rows)
    signal = F.when(F.col("z") >= 1.5, "short").when(F.col("z") <= -1.5, "long").when(F.abs("z") >= 1.0, "watch").otherwise("flat")
    return z.select("a", "b", "dt", "spread", "z", signal.alias("signal"))


def half_life(spreads: DataFrame) -> DataFrame:
    """-ln 2 / beta of the spread's regression on its lag, within [1, 252]; null if beta >= 0 or undefined."""
    w = Window.partitionBy("a", "b").orderBy("dt")
    d = spreads.withColumn("_l", F.lag("spread").over(w)).where("_l is not null").withColumn("_d", F.col("spread") - F.col("_l"))
    g = d.groupBy("a", "b").agg(F.try_divide(F.covar_samp("_d", "_l"), F.var_pop("_l")).alias("beta"), (F.stddev_samp("_d") * F.sqrt(F.lit(252.0))).alias("annual_vol"))
    return g.withColumn("half_life", F.when(F.col("beta") < 0, F.greatest(F.lit(1.0), F.least(F.lit(252.0), -LN2 / F.col("beta")))))


def max_drawdown(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """min(x - running max of x) per key."""
    w = _by(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_d", F.col(value) - F.max(value).over(w)).groupBy(key).agg(F.min("_d").alias("max_drawdown"))


def positions(spreads: DataFrame, entry: float = 1.5, days: int = 60) -> DataFrame:
    """Trades of the position machine: flat, then +-1 beyond the entry, out where z crosses 0 or after ``days`` rows.

    a, b, entry_dt, exit_dt, side, held, pnl (change of the spread in the side's direction). Order-dependent, so one
    pair is worked off in one task, by date.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("dt")
        out, side, at, s0 = [], 0, 0, 0.0
        for i, (z, s) in enumerate(zip(g["z"], g["spread"])):
            if side == 0:
                if abs(z) > entry:
                    side, at, s0 = (-1 if z > 0 else 1), i, s
            elif z * side >= 0 or i - at >= days:
                out.append((g["a"].iloc[0], g["b"].iloc[0], g["dt"].iloc[at], g["dt"].iloc[i], side, i - at, side * (s - s0)))
                side = 0
        return pd.DataFrame(out, columns=["a", "b", "entry_dt", "exit_dt", "side", "held", "pnl"])

    kind = spreads.schema["dt"].dataType.simpleString()
    return spreads.where("z is not null").groupBy("a", "b").applyInPandas(run, f"a string, b string, entry_dt {kind}, exit_dt {kind}, side int, held int, pnl double")


def quote(prices: DataFrame) -> DataFrame:
    """Last and previous close of each ticker, change and change in per cent (rounded to 2)."""
    w = Window.partitionBy("ticker").orderBy(F.col("dt").desc())
    r = prices.withColumn("_k", F.row_number().over(w)).where("_k <= 2")
    g = r.groupBy("ticker").agg(F.max(F.when(F.col("_k") == 1, F.col("close"))).alias("last"), F.max(F.when(F.col("_k") == 2, F.col("close"))).alias("previous"))
    return g.withColumn("change", F.round(F.col("last") - F.col("previous"), 2)).withColumn("change_pct", F.round(F.try_divide(100 * (F.col("last") - F.col("previous")), F.col("previous")), 2))


def indicator_change(points: DataFrame, days: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Per key the change in per cent against the last value at or before latest - n days (else the oldest), and the trend over 7 days."""
    end = points.groupBy("ticker").agg(F.max("dt").alias("_end"), F.max_by("close", "dt").alias("latest"), F.min_by("close", "dt").alias("_oldest"))
    j = points.join(end, "ticker")
    aggs = [F.max_by(F.when(F.col("dt") <= F.date_sub("_end", n), F.col("close")), F.when(F.col("dt") <= F.date_sub("_end", n), F.col("dt"))).alias(f"_p{n}") for n in days]
    g = j.groupBy("ticker", "latest", "_oldest").agg(*aggs)
    pct = {n: F.try_divide(100 * (F.col("latest") - F.coalesce(f"_p{n}", "_oldest")), F.coalesce(f"_p{n}", "_oldest")) for n in days}
    trend = F.when(pct[7] > 0.5, "up").when(pct[7] < -0.5, "down").otherwise("flat")
    return g.select("ticker", "latest", *[F.round(p, 4).alias(f"pct_{n}d") for n, p in pct.items()], trend.alias("trend"))


def yearly_growth(rows: DataFrame, key: str, year: str, value: str) -> DataFrame:
    """100 (current - previous) / |previous| against the year before, rounded to 2; null without one or where it is 0."""
    prev = rows.select(key, (F.col(year) + 1).alias(year), F.col(value).alias("_p"))
    return rows.join(prev, [key, year], "left").withColumn("growth", F.round(F.try_divide(100 * (F.col(value) - F.col("_p")), F.abs("_p")), 2)).drop("_p")
