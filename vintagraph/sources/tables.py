"""Parquet tables of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagraph.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``<folder>/<name>.parquet`` (a file or a folder of part files).

    Zoneless timestamps are read as UTC, for which the session time zone is set here; the executors get this package here too.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unique(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """A table with one row per ``key``: of repeated rows the greatest, whatever the order they are read in. A null key is one."""
    df = table(spark, folder, name)
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(*rest)).alias("_v")).select(key, "_v.*").select(*df.columns)
