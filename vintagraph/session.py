"""Session helpers: sessions for local use, reliable checkpoints, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a dimension is broadcast (a row here is a few dozen bytes).
BROADCAST_ROWS = 100_000
#: Bytes up to which it is, whatever its rows.
BROADCAST_BYTES = 64 << 20


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. The session's own setting wins.

    Without one a local master gets a temporary folder, removed at exit; on a cluster, whose executors share no such
    folder, it is an error.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="vintagraph-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    if "://" not in path:
        os.makedirs(path, exist_ok=True)
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there from now on.

    Used where a result is read more than once; unlike a cache it survives the loss of executors.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and about ``size`` bytes, else unchanged.

    Counts ``df``, so pass a cut or otherwise cheap frame. Texts, binaries and arrays count by their lengths.
    """
    held = F.lit(16 * len(df.columns))
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            held = held + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        elif kind in ("array", "map"):
            held = held + 24 * F.greatest(F.size(f"`{f.name}`"), F.lit(0))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(held.cast("bigint"))).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp column (zoneless ones are read as UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is read in fewer partitions than there are (a few files, or one); else unchanged.

    For work that costs far more per row than moving the row does. Large inputs have more splits than cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per context, unless PYTHONPATH already has it there."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if getattr(sc, "_vintagraph_shipped", False) or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc._vintagraph_shipped = True
    path = os.path.join(tempfile.mkdtemp(prefix="vintagraph-"), "vintagraph.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(os.path.join(root, "vintagraph")):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), root))
    sc.addPyFile(path)  # Spark's file server hands it to the executors
