"""Incremental forms of the batch operators, on Structured Streaming.

Late rows are new versions here, never errors: the watermark bounds only the state kept for repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from vintagraph.operators.bitemporal import append_new


def read_new(spark: SparkSession, folder: str, schema: StructType, files: int = 100) -> DataFrame:
    """Parquet files that appear in ``folder``; the checkpoint of the query is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def without_repeats(stream: DataFrame, keys: list[str], t: str, delay: str) -> DataFrame:
    """Each key once, as far as repeats come within ``delay``."""
    return stream.withWatermark(t, delay).dropDuplicatesWithinWatermark(keys)


def append_once(stream: DataFrame, store: str, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Append the rows whose keys the store does not hold yet; whatever runs twice appends once."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            held = spark.read.schema(batch.schema).parquet(store)
        except Exception as e:  # the store's folder does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            held = spark.createDataFrame([], batch.schema)
        append_new(held, batch, keys, order).write.mode("append").parquet(store)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, t: str, width: str, slide: str | None, delay: str, value: str, by: list[str]) -> DataFrame:
    """n, mean and error share per window and group; windows close ``delay`` after their end."""
    w = F.window(t, width, slide) if slide else F.window(t, width)
    return stream.withWatermark(t, delay).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), *by, "n", "mean")


def ema_state(stream: DataFrame, key: str, t: str, value: str, alpha: float = 0.2) -> DataFrame:
    """key, n, score, volatility after each micro-batch, with the state of each key kept between them."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(k, frames, state):
        n, s, v = state.get if state.exists else (0, 0.0, 0.0)
        for f in frames:
            for x in f.sort_values(t)[value]:
                if x is None or x != x:
                    continue
                if n == 0:
                    s, v = x, 0.0
                else:
                    s, v = alpha * x + (1 - alpha) * s, alpha * abs(x - s) + (1 - alpha) * v
                n += 1
        state.update((n, s, v))
        yield pd.DataFrame({key: [k[0]], "n": [n], "score": [s], "volatility": [v]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n bigint, score double, volatility double", "n bigint, s double, v double", "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run what is there to the end; every micro-batch is written beside the checkpoint, none passes through the driver.

    In mode 'complete' the last batch is returned, otherwise the rows of all of them.
    """
    out = f"{checkpoint.rstrip('/')}-{name}"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    write(stream.sparkSession.createDataFrame([], stream.schema), -1)  # a stream without data has no batch
    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = stream.sparkSession.read.parquet(out)
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") == F.coalesce(F.lit(last), F.lit(-1)))
    return rows.drop("batch")


def since(rows: DataFrame, cursor: str, last, limit: int | None = None) -> DataFrame:
    """The rows after a cursor, in its order; the first ``limit`` of them if given. Without a cursor (null) from the start."""
    r = rows.where(F.col(cursor).isNotNull())
    r = r if last is None else r.where(F.col(cursor) > F.lit(last))
    return r if limit is None else r.orderBy(cursor).limit(limit)
