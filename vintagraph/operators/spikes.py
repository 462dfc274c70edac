"""Implausible spikes in measurements (problem 7): robust control charts per series.

Each series has exponentially weighted charts of its level and of its usual change between readings; both follow the
series, so limits widen and narrow with it. A reading far off the level is suspected: it is clipped to the limit of the
update before level and scale take it in, so that spikes neither drag the level nor widen the limits. It is a spike if
the readings come back to the level from before it within three, and a new level if they don't. Run-length counters
find stuck runs and physical limits find impossible values.

Series are cut into blocks of bounded size; a block's charts warm up on the last readings of the block before it and
look at the first ones of the block after it, so a hot series is many tasks. The scale starts at the median change of
the warm-up; in series that stand still, where that holds few moves or none, at the usual move of the whole series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintagraph.operators.blocks import with_blocks, with_context
from vintagraph.session import cut, micros, small

BLOCK, WARM, AHEAD = 4096, 256, 32
#: Limits in usual changes: of a spike, in a series that moves and in one that mostly stands still; a mean absolute
#: change is about 1.18 medians of a normal one.
MOVING, STILL = 10.0, 3.0
#: Readings in a row that make a stuck run, and at most in a spike.
STUCK, SPIKE = 8, 3
ALPHA_LEVEL, ALPHA_SCALE = 0.5, 0.02
#: Usual changes to which a suspected value and a change are clipped.
CLIP = 3.0
#: Mean change in medians where changes are normal, and what the clip leaves of the mean: the scale is a mean change.
MEDIANS, LEFT = 1.18, 0.988


def impossible(observations: DataFrame, limits: DataFrame) -> DataFrame:
    """observation_id of the versions outside min_possible..max_possible of their series (null bounds are none; NaN is no value)."""
    lim = limits.groupBy("series_id").agg(F.max("min_possible").alias("lo"), F.min("max_possible").alias("hi")).where("lo is not null or hi is not null")
    o = observations.where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("observation_id").isNotNull())
    j = o.join(small(lim), "series_id").where((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")))
    return j.select("observation_id").distinct()


def first_versions(observations: DataFrame, limits: DataFrame) -> DataFrame:
    """series_id, t, observation_id, value: the first version of each reading, without null, NaN and impossible values.

    A version with null as_of comes after all others of its reading; ties go to the smaller observation_id.
    """
    lim = limits.groupBy("series_id").agg(F.max("min_possible").alias("lo"), F.min("max_possible").alias("hi"))
    o = observations.where("series_id is not null and timestamp is not null and observation_id is not null").select("series_id", micros("timestamp").alias("t"), micros("as_of").alias("k"), "observation_id", "value")
    first = o.groupBy("series_id", "t").agg(F.min(F.struct(F.coalesce("k", F.lit(2**62)).alias("k"), "observation_id", "value")).alias("v"))
    f = first.select("series_id", "t", "v.observation_id", "v.value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    ok = F.coalesce(F.col("value") >= F.col("lo"), F.lit(True)) & F.coalesce(F.col("value") <= F.col("hi"), F.lit(True))
    return f.join(small(lim), "series_id", "left").where(ok).drop("lo", "hi")


def start(values: np.ndarray, still: bool) -> float:
    """The median change in ``values``, 0 if there is none; a still series has too few moves there to tell."""
    return 0.0 if still or len(values) < 2 else float(np.median(np.abs(np.diff(values))))


def chart(values: np.ndarray, usual: float, still: bool, alpha: float | None = None) -> np.ndarray:
    """Which of the values are spikes. ``usual``: the usual change that the scale starts with; ``alpha``: its weight."""
    n = len(values)
    out = np.zeros(n, dtype=bool)
    if n == 0 or not usual > 0:
        return out
    weight = ALPHA_SCALE if alpha is None else alpha
    limit = STILL if still else MOVING
    same = limit / 2
    level, scale = float(np.median(values[: min(n, 5)])), usual * (1.0 if still else MEDIANS)
    last, since, held = level, -1, (level, scale, level)
    for i, x in enumerate(values.tolist()):
        if since >= 0:  # an excursion is open: compare with the level before it
            before = held[0]
            if abs(x - before) <= same * held[1]:
                out[since:i] = True
                level, scale, last = held
                since = -1
            elif i - since >= SPIKE:  # a level that lasts is no spike
                level = last = float(np.median(values[since : i + 1]))
                scale, since = held[1], -1
        if since < 0 and abs(x - level) > limit * scale:
            since, held = i, (level, scale, last)
        room = CLIP * scale
        x = min(max(x, level - room), level + room) if since >= 0 else x
        change = min(abs(x - last), room)
        if change > 0:  # a frozen sensor tells nothing about changes
            scale += weight * (change / (1.0 if still else LEFT) - scale)
        level = x if still and since < 0 else level + ALPHA_LEVEL * (x - level)
        last = x
    return out


def stuck(values: np.ndarray) -> np.ndarray:
    """Which of the values belong to a run of at least STUCK equal ones."""
    n = len(values)
    if n == 0:
        return np.zeros(0, dtype=bool)
    edge = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True])
    length = np.diff(edge)
    return np.repeat(length >= STUCK, length)


def _scan(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    g = group.sort_values(["t", "observation_id"], kind="stable")
    v = g["value"].to_numpy(dtype=float)
    still, usual = bool(g["still"].iloc[0]), float(g["usual"].iloc[0])
    s = chart(v, start(v[:WARM], still) or usual, still)
    own = (g["block"] == g["to"]).to_numpy()
    kinds = [("spike", s)] + ([] if still else [("stuck", stuck(v))])
    ids = g["observation_id"].to_numpy()
    return pd.concat([pd.DataFrame({"observation_id": ids[m & own], "kind": k}) for k, m in kinds])


def spikes_and_stuck(observations: DataFrame, limits: DataFrame) -> DataFrame:
    """observation_id, kind ('spike', 'stuck') of the first versions of readings.

    A series that stands still more than half of the time has a chart of its moves alone (then nothing counts as
    stuck); ``usual`` is the median change of the series, for warm-ups that hold no change. Series with a single
    reading, or that never change, have no spikes.
    """
    blocked = with_blocks(first_versions(observations, limits), "series_id", "t", BLOCK, count=observations.count())
    d = blocked.withColumn("d", F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("series_id", "block").orderBy("t")))).where("d is not null")
    usual = d.groupBy("series_id").agg((F.avg((F.col("d") == 0).cast("int")) > 0.5).alias("still"), F.percentile_approx("d", 0.5, 10000).alias("_all"), F.percentile_approx(F.when(F.col("d") > 0, F.col("d")), 0.5, 10000).alias("_moves"))
    usual = usual.select("series_id", "still", F.coalesce(F.when(F.col("still") | (F.col("_all") == 0), F.col("_moves")).otherwise(F.col("_all")), F.lit(0.0)).alias("usual"))
    ctx = with_context(blocked, "series_id", "t", WARM, AHEAD).join(small(usual), "series_id")
    return ctx.groupBy("series_id", "to").applyInPandas(_scan, "observation_id string, kind string")


def implausible(observations: DataFrame, limits: DataFrame) -> DataFrame:
    """observation_id, kind: 'impossible' in any version, 'spike' and 'stuck' in first versions."""
    imp = impossible(observations, limits).withColumn("kind", F.lit("impossible"))
    return imp.unionByName(spikes_and_stuck(observations, limits)).distinct()


