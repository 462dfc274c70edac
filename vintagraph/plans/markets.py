"""Queries over prices made from the orders of a brand's parts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vintagraph.operators import pairs as P
from vintagraph.plans.registry import Registry
from vintagraph.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def prices(s, d):
    """ticker (order priority), dt, close (mean order price of the day)."""
    o = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("dt"))
    return o.agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")) / F.count(F.lit(1))).cast("double").alias("close"))


def sectors(s, d):
    return prices(s, d).select("ticker").distinct().withColumn("sector", F.lit("all"))


_P = "WITH p AS (SELECT o_orderpriority ticker, o_orderdate::DATE dt, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) \"close\" FROM orders GROUP BY 1, 2)"
_F = _P + """, g AS (SELECT dt, ticker FROM (SELECT DISTINCT dt FROM p), (SELECT DISTINCT ticker FROM p)),
f AS (SELECT * FROM (SELECT dt, ticker, last_value(p."close" IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY dt ROWS UNBOUNDED PRECEDING) "close" FROM g LEFT JOIN p USING (dt, ticker)) WHERE "close" IS NOT NULL),
l AS (SELECT dt, ticker, ln("close" / lag("close") OVER (PARTITION BY ticker ORDER BY dt)) r FROM f),
r AS (SELECT * FROM l WHERE r IS NOT NULL AND dt IN (SELECT dt FROM l WHERE r IS NOT NULL GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT ticker) FROM f)))"""
_XY = _F + """, xy AS (SELECT x.ticker a, y.ticker b, x.dt, x."close" x, y."close" y FROM f x JOIN f y ON x.dt = y.dt AND x.ticker < y.ticker),
s AS (SELECT a, b, dt, ln(x / y) spread FROM xy),
z AS (SELECT a, b, dt, spread, (spread - avg(spread) OVER w) / stddev_samp(spread) OVER w z, count(*) OVER w n FROM s WINDOW w AS (PARTITION BY a, b ORDER BY dt ROWS 62 PRECEDING))"""


@query(_F + ' SELECT dt::VARCHAR dt, ticker, round("close", 4) AS "close" FROM f')
def price_fill(s, d):
    return P.fill_forward(prices(s, d)).select(F.col("dt").cast("string").alias("dt"), "ticker", F.round("close", 4).alias("close"))


@query(_F + " SELECT dt::VARCHAR dt, ticker, round(r, 8) r FROM r")
def log_returns(s, d):
    return P.log_returns(P.fill_forward(prices(s, d))).select(F.col("dt").cast("string").alias("dt"), "ticker", F.round("r", 8).alias("r"))


@query(_F + ", k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) k FROM r) SELECT ticker, round(CASE WHEN count(*) >= 63 THEN exp(sum(r)) - 1 END, 6) momentum FROM k WHERE k <= 63 GROUP BY 1")
def momentum(s, d):
    return P.momentum(P.log_returns(P.fill_forward(prices(s, d))), 63).withColumn("momentum", F.round("momentum", 6))


def _xy(s, d):
    f = P.fill_forward(prices(s, d))
    return P.two(f, P.pairs_within(sectors(s, d)), "close")


@query(_F + """, xy AS (SELECT x.ticker a, y.ticker b, x.dt, x.r x, y.r y FROM r x JOIN r y ON x.dt = y.dt AND x.ticker < y.ticker),
c AS (SELECT a, b, count(*) OVER w n, covar_pop(x, y) OVER w / (stddev_pop(x) OVER w * stddev_pop(y) OVER w) c FROM xy WINDOW w AS (PARTITION BY a, b ORDER BY dt ROWS 119 PRECEDING))
SELECT a, b, round(avg(c), 6) mean_corr FROM c WHERE n = 120 GROUP BY 1, 2""")
def pair_corr(s, d):
    xy = P.two(P.log_returns(P.fill_forward(prices(s, d))), P.pairs_within(sectors(s, d)), "r")
    return P.rolling_corr_mean(xy, 120).withColumn("mean_corr", F.round("mean_corr", 6))


@query(_XY + " SELECT a, b, dt::VARCHAR dt, round(spread, 8) spread, round(z, 6) z, CASE WHEN z >= 1.5 THEN 'short' WHEN z <= -1.5 THEN 'long' WHEN abs(z) >= 1.0 THEN 'watch' ELSE 'flat' END signal FROM z WHERE n = 63")
def spread_signal(s, d):
    return P.spread_z(_xy(s, d)).withColumn("spread", F.round("spread", 8)).withColumn("z", F.round("z", 6)).withColumn("dt", F.col("dt").cast("string"))


@query(_XY + ", q AS (SELECT *, lag(spread) OVER (PARTITION BY a, b ORDER BY dt) l FROM z WHERE n = 63), b AS (SELECT a, b, covar_samp(spread - l, l) / var_pop(l) beta, stddev_samp(spread - l) * sqrt(252) v FROM q WHERE l IS NOT NULL GROUP BY 1, 2) SELECT a, b, round(beta, 6) beta, round(v, 6) annual_vol, round(CASE WHEN beta < 0 THEN greatest(1.0, least(252.0, -ln(2) / beta)) END, 4) half_life FROM b")
def half_life(s, d):
    h = P.half_life(P.spread_z(_xy(s, d)))
    return h.select("a", "b", F.round("beta", 6).alias("beta"), F.round("annual_vol", 6).alias("annual_vol"), F.round("half_life", 4).alias("half_life"))


@query(_F + ', m AS (SELECT ticker, "close" - max("close") OVER (PARTITION BY ticker ORDER BY dt ROWS UNBOUNDED PRECEDING) x FROM f) SELECT ticker, round(min(x), 4) max_drawdown FROM m GROUP BY 1')
def drawdown(s, d):
    return P.max_drawdown(P.fill_forward(prices(s, d)), "ticker", "dt", "close").withColumn("max_drawdown", F.round("max_drawdown", 4))


@query()
def backtest_machine(s, d):
    return P.positions(P.spread_z(_xy(s, d)))


@query(_F + """, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) k FROM f), q AS (SELECT ticker, max("close") FILTER (k = 1) "last", max("close") FILTER (k = 2) previous FROM k WHERE k <= 2 GROUP BY 1)
SELECT ticker, round("last", 4) AS "last", round(previous, 4) previous, round("last" - previous, 2) AS "change", round(100 * ("last" - previous) / previous, 2) change_pct FROM q""")
def quote_summary(s, d):
    return P.quote(P.fill_forward(prices(s, d))).withColumn("last", F.round("last", 4)).withColumn("previous", F.round("previous", 4))


@query(_F + """, e AS (SELECT ticker, max(dt) e, max_by("close", dt) latest, min_by("close", dt) oldest FROM f GROUP BY 1),
b AS (SELECT ticker, latest, coalesce(max_by("close", dt) FILTER (dt <= e - 1), oldest) a, coalesce(max_by("close", dt) FILTER (dt <= e - 7), oldest) b, coalesce(max_by("close", dt) FILTER (dt <= e - 30), oldest) c FROM f JOIN e USING (ticker) GROUP BY ticker, latest, oldest)
SELECT ticker, round(latest, 4) latest, round(100 * (latest - a) / a, 4) pct_1d, round(100 * (latest - b) / b, 4) pct_7d, round(100 * (latest - c) / c, 4) pct_30d,
CASE WHEN 100 * (latest - b) / b > 0.5 THEN 'up' WHEN 100 * (latest - b) / b < -0.5 THEN 'down' ELSE 'flat' END trend FROM b""")
def indicator_change(s, d):
    return P.indicator_change(P.fill_forward(prices(s, d))).withColumn("latest", F.round("latest", 4))


@query("""WITH y AS (SELECT c_nationkey nation, year(o_orderdate)::INT AS "year", sum(o_totalprice::DECIMAL(18,2))::DOUBLE revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT y.nation, y."year", y.revenue, round(100 * (y.revenue - p.revenue) / abs(p.revenue), 2) growth FROM y LEFT JOIN y p ON p.nation = y.nation AND p."year" = y."year" - 1""")
def yoy_growth(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    y = o.groupBy(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("year")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue"))
    return P.yearly_growth(y, "nation", "year", "revenue")


@query(_F + """, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) k FROM r), m AS (SELECT ticker, exp(sum(r)) - 1 m FROM k WHERE k <= 21 GROUP BY 1 HAVING count(*) >= 21)
SELECT x.ticker a, y.ticker b, round(m.m, 6) mom_a, round(n.m, 6) mom_b FROM (SELECT DISTINCT ticker FROM p) x JOIN (SELECT DISTINCT ticker FROM p) y ON x.ticker < y.ticker LEFT JOIN m ON m.ticker = x.ticker LEFT JOIN m n ON n.ticker = y.ticker""")
def pair_enrich(s, d):
    m = P.momentum(P.log_returns(P.fill_forward(prices(s, d))), 21).withColumn("momentum", F.round("momentum", 6))
    p = P.pairs_within(sectors(s, d)).select("a", "b")
    return p.join(m.select(F.col("ticker").alias("a"), F.col("momentum").alias("mom_a")), "a", "left").join(m.select(F.col("ticker").alias("b"), F.col("momentum").alias("mom_b")), "b", "left").select("a", "b", "mom_a", "mom_b")
