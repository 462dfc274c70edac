"""Order-dependent state folded over a key's events, without one task per key.

An exponential average forgets: after WARM events the start plays no part within double precision (0.8^256 < 1e-24).
Events are therefore cut into blocks; each block starts WARM events early and is folded on its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintagraph.operators.blocks import with_blocks, with_context

ALPHA, WARM, BLOCK = 0.2, 256, 4096


def fold(x: np.ndarray, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Score and volatility after each event: s' = a x + (1 - a) s, v' = a |x - s| + (1 - a) v; the first sets s = x, v = 0."""
    s, v, score, vol = 0.0, 0.0, np.empty(len(x)), np.empty(len(x))
    for i, y in enumerate(x.tolist()):
        if i == 0:
            s, v = y, 0.0
        else:
            s, v = alpha * y + (1 - alpha) * s, alpha * abs(y - s) + (1 - alpha) * v
        score[i], vol[i] = s, v
    return score, vol


def ema(events: DataFrame, key: str, t: str, tie: str, value: str, alpha: float = ALPHA) -> DataFrame:
    """key, tie, score, volatility after every event in order of (t, tie); null values and keys are left out.

    ``t`` is a bigint, ``tie`` a unique id.
    """
    e = events.where(F.col(value).isNotNull() & F.col(t).isNotNull()).select(F.col(key).alias("_k"), F.col(t).alias("_t"), F.col(tie).alias("_id"), F.col(value).cast("double").alias("_x"))
    both = with_context(with_blocks(e, "_k", "_t", BLOCK, ("_id",), events.count()), "_k", "_t", WARM, 0, ("_id",))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["_t", "_id"])
        s, v = fold(g["_x"].to_numpy(), alpha)
        own = (g["block"] == g["to"]).to_numpy()
        return pd.DataFrame({key: g["_k"][own], tie: g["_id"][own], "score": s[own], "volatility": v[own]})

    k, i = events.schema[key].dataType.simpleString(), events.schema[tie].dataType.simpleString()
    return both.groupBy("_k", "to").applyInPandas(run, f"{key} {k}, {tie} {i}, score double, volatility double")


def transitions(states: DataFrame, key: str, t: str, state: str) -> DataFrame:
    """Rows whose state differs from the one before of the same key, with ``previous``; the first is none."""
    p = states.withColumn("previous", F.lag(state).over(Window.partitionBy(key).orderBy(t)))
    return p.where(F.col("previous") != F.col(state))
