"""Cutting long ordered histories into blocks of bounded size.

A series that holds a third of all rows must not end up in one task, nor may one odd time, a burst or an instant with
very many rows. ``in_order`` sorts rows over range partitions, whose bounds Spark takes from a sample of the whole sort
key, ties included; ``with_blocks`` numbers every ``target`` rows of that order as a block, so blocks are even however
the times are spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintagraph.session import cut, small

#: Rows a range partition holds, about, and the fewest for which one is worth a task.
PART, LEAST = 1 << 18, 1 << 13


def in_order(rows: DataFrame, by: list[str], count: int | None = None) -> DataFrame:
    """``rows`` sorted by ``by`` over partitions of about PART rows, fewer where there are cores for more.

    Rows that are equal in all of ``by`` share a partition: end ``by`` with what tells rows apart.
    """
    n = rows.count() if count is None else count
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // PART), min(cores, -(-n // LEAST)))
    return rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)


def with_blocks(history: DataFrame, key: str, t: str, target: int, ties: tuple[str, ...] = (), count: int | None = None) -> DataFrame:
    """Add ``block`` (bigint, ascending in ``t``, then ``ties``, within ``key``) to ``history``; the result is cut.

    Rows with a null key or ``t`` are dropped. A block of a key holds at most ``target`` rows (rounded up to a power of
    two). Block numbers may have gaps. ``count``: about how many rows there are, if known more cheaply than by counting.
    """
    h = history.where(F.col(key).isNotNull() & F.col(t).isNotNull())
    bits = max(0, (target - 1).bit_length())
    # the id counts up along the sort order of a partition and the partitions are in order
    return cut(in_order(h, [key, t, *ties], count).withColumn("block", F.shiftright(F.monotonically_increasing_id(), bits)))


def running_sum(rows: DataFrame, by: list[str], sums: dict[str, str], key: str | None = None, count: int | None = None) -> DataFrame:
    """``rows`` with each of ``sums`` (name -> column): the sum over all rows up to each, of its ``key`` if given, in
    ascending order of ``by``; the result is cut.

    Partitions of the order are summed on their own, and get the sums of those before them; no task sees all rows, nor
    all of a key. End ``by`` with what tells rows apart; null amounts count 0. ``count``: about how many rows there are.
    """
    own = [key] if key else []
    line = cut(in_order(rows, [*own, *by], count).withColumn("_p", F.spark_partition_id()))
    total = {n: F.coalesce(F.sum(c), F.lit(0)) for n, c in sums.items()}
    parts = line.groupBy("_p", *own).agg(*[x.alias(f"_t_{n}") for n, x in total.items()])  # one row a partition, and key in it
    earlier = Window.partitionBy(*own).orderBy("_p")
    before = parts.select("_p", *own, *[(F.sum(f"_t_{n}").over(earlier) - F.col(f"_t_{n}")).alias(f"_b_{n}") for n in sums])
    if own:  # keys within one partition have nothing before them
        before = before.where(" or ".join(f"_b_{n} <> 0" for n in sums))
    w = Window.partitionBy("_p", *own).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    inner = line.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()}).join(small(cut(before)), ["_p", *own], "left")
    return inner.withColumns({n: F.col(n) + F.coalesce(f"_b_{n}", F.lit(0)) for n in sums}).drop("_p", *[f"_b_{n}" for n in sums])


def with_context(blocked: DataFrame, key: str, t: str, before: int, after: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """Copy the edge rows of each block to its neighbours: ``to`` is the block that reads the row.

    Each block also reads the last ``before`` rows before it and the first ``after`` rows after it, from as many blocks
    as hold them; block numbers may have gaps. The row's own block stays in ``block``; a row is context where ``to``
    differs from it.
    """
    by = Window.partitionBy(key).orderBy("block")  # one row a block
    n = blocked.groupBy(key, "block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_e", F.sum("_n").over(by)).withColumn("_s", F.col("_e") - F.col("_n"))
    ahead, back = (F.collect_list(F.struct("block", "_s", "_e")).over(by.rowsBetween(*x)) for x in ((1, max(before, 1)), (-max(after, 1), -1)))
    n = n.withColumn("_next", ahead).withColumn("_prev", back)
    n = n.withColumn("_next", F.filter("_next", lambda x: x["_s"] - F.col("_e") < before)).withColumn("_prev", F.filter("_prev", lambda x: F.col("_s") - x["_e"] < after))
    r = blocked.withColumn("_r", F.row_number().over(Window.partitionBy(key, "block").orderBy(t, *ties))).join(small(cut(n)), [key, "block"])
    right = F.filter("_next", lambda x: F.col("_n") - F.col("_r") + x["_s"] - F.col("_e") < before)["block"]
    left = F.filter("_prev", lambda x: F.col("_r") - 1 + F.col("_s") - x["_e"] < after)["block"]
    return r.withColumn("to", F.explode_outer(F.concat(F.array("block"), left, right))).drop("_r", "_n", "_s", "_e", "_next", "_prev").select(*blocked.columns, "to")
