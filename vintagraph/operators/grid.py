"""Irregular readings onto a regular grid (problem 5), by validity intervals.

A reading holds from its time to the next reading of its series. These intervals are intersected with the grid
cells; a cell's value is the time-weighted average over the part of it that is covered, and its coverage the
covered share. A reading holds for at most ``hold`` steps, so long gaps come out uncovered instead of flat.

Successors are found within blocks of ``SPAN`` periods and across them through the first reading of each later
block, so no task sorts a whole series; long intervals are expanded in two steps of bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintagraph.session import micros

SECOND = 1_000_000
#: Periods a block of a series.
SPAN = 512


def usable(observations: DataFrame) -> DataFrame:
    """Readings with a value and not flagged missing; ties of (series, time) keep the version known last."""
    flag = F.lower(F.trim(F.coalesce("quality_flag", F.lit(""))))
    o = observations.where(F.col("value").isNotNull() & ~F.isnan("value") & (flag != "missing") & F.col("series_id").isNotNull() & F.col("timestamp").isNotNull())
    o = o.select("series_id", micros("timestamp").alias("t"), micros("as_of").alias("k"), "value")
    return o.groupBy("series_id", "t").agg(F.max_by("value", F.struct(F.coalesce("k", F.lit(-(2**62))), "value")).alias("value"))


def regular_grid(observations: DataFrame, steps: DataFrame, hold: float = 3.0) -> DataFrame:
    """One row per series and period from its first to its last usable reading.

    ``steps``: series_id, step_seconds. Columns: series_id, period_start (seconds), n_readings, value (time-weighted
    average over the covered part, null if nothing covers it), coverage (0..1), status: 'observed', 'filled' (no
    reading in it but covered by an earlier one) or 'gap'. Series without a positive step, or without readings,
    give no rows. The time before a series' first reading is uncovered.
    """
    st = steps.where("step_seconds > 0 and series_id is not null").groupBy("series_id").agg((F.min("step_seconds") * SECOND).cast("bigint").alias("step"))
    r = usable(observations).join(st, "series_id")
    r = r.withColumn("p", F.floor(F.col("t") / F.col("step"))).withColumn("b", F.floor(F.col("p") / SPAN))
    firsts = r.groupBy("series_id", "b").agg(F.min("t").alias("first"))
    nxt = firsts.withColumn("next_first", F.lead("first").over(Window.partitionBy("series_id").orderBy("b"))).select("series_id", "b", "next_first")
    w = Window.partitionBy("series_id", "b").orderBy("t")
    i = r.withColumn("to", F.lead("t").over(w)).join(nxt, ["series_id", "b"])
    i = i.withColumn("to", F.coalesce("to", "next_first")).withColumn("until", F.least(F.coalesce("to", F.col("t")), F.col("t") + (F.col("step") * hold).cast("bigint")))
    # cells from the reading's own to the one of its successor (which lists itself)
    last = F.when(F.col("to").isNull(), F.col("p")).otherwise(F.greatest(F.col("p"), F.floor(F.col("to") / F.col("step")) - F.when(F.pmod("to", "step") == 0, 1).otherwise(0)))
    i = i.withColumn("last", last.cast("bigint")).withColumn("c", F.explode(F.sequence(F.col("b"), F.floor(F.col("last") / SPAN))))
    i = i.withColumn("q", F.explode(F.sequence(F.greatest(F.col("p"), F.col("c") * SPAN), F.least(F.col("last"), F.col("c") * SPAN + SPAN - 1))))
    overlap = F.greatest(F.lit(0), F.least(F.col("until"), (F.col("q") + 1) * F.col("step")) - F.greatest(F.col("t"), F.col("q") * F.col("step"))).cast("double")
    cells = i.withColumn("_o", overlap).groupBy("series_id", "q", "step").agg(
        F.count(F.when(F.col("q") == F.col("p"), 1)).alias("n_readings"),
        F.sum("_o").alias("_o"),
        F.sum(F.col("_o") * F.col("value")).alias("_ov"),
        F.avg(F.when(F.col("q") == F.col("p"), F.col("value"))).alias("_own"),
    )
    status = F.when(F.col("n_readings") > 0, "observed").when(F.col("_o") > 0, "filled").otherwise("gap")
    value = F.when(F.col("_o") > 0, F.col("_ov") / F.col("_o")).otherwise(F.col("_own"))
    return cells.select("series_id", (F.col("q") * F.floor(F.col("step") / SECOND)).cast("bigint").alias("period_start"), "n_readings", value.alias("value"), F.least(F.lit(1.0), F.col("_o") / F.col("step")).alias("coverage"), status.alias("status"))
