"""References to records that do not exist (problem 3).

Distinct foreign keys are anti-joined against the distinct parent keys; what is left over is 'missing'. For keys
that have a parent at all, liveness at the time of the reference is decided by running counts of the parent's
births and deaths over ordered partitions (``blocks.running_sum``), so that neither a hot foreign key, a bulk load in
one day nor a parent with very many lifetimes ends up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagraph.operators.blocks import running_sum
from vintagraph.session import cut, micros

#: Blanks that surround ids: everything Java's Unicode-aware \s covers, and zero-width marks.
_EDGE = r"(?U)^[\s​﻿]+|[\s​﻿]+$"


def key_of(col: str | Column) -> Column:
    """An id as it is compared: without surrounding blanks, lower case; null or blank ids become null."""
    c = F.col(col) if isinstance(col, str) else col
    k = F.lower(F.regexp_replace(c, _EDGE, ""))
    return F.when(k != "", k)


def references(rows: DataFrame, row_id: str, endpoints: dict[str, str], at: str, table: str) -> DataFrame:
    """One row per reference: ``table``, ``row_id``, ``endpoint``, ``key``, ``at`` (bigint micros); no-references left out.

    ``endpoints`` maps the endpoint's name to its column. Repeated rows count once.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("endpoint"), key_of(c).alias("key")) for n, c in endpoints.items()])).alias("_r")
    r = rows.select(F.col(row_id).alias("row_id"), micros(at).alias("at"), pairs).select(F.lit(table).alias("table"), "row_id", "_r.endpoint", "_r.key", "at")
    return r.where("key is not null").distinct()


def orphans(refs: DataFrame, parents: DataFrame, parent_id: str, born: str, died: str) -> DataFrame:
    """``refs`` (see ``references``) that point to no parent live at ``at``, with ``reason``.

    A parent row is live from ``born`` (included) to ``died`` (excluded, null = never). An id may have several
    lifetimes; repeated rows count once; a lifetime without ``born``, or that ends before it begins, is never live.
    reason: 'missing' if no parent row has the key, else 'deleted' if one has died by then, else 'late'. A reference
    without a time is an orphan only when its key is missing.
    """
    lives = parents.select(key_of(parent_id).alias("key"), micros(born).alias("born"), micros(died).alias("died")).where("key is not null").distinct()
    keys = refs.select("key").distinct()
    absent = keys.join(lives.select("key").distinct(), "key", "left_anti").withColumn("absent", F.lit(True))
    tagged = cut(refs.join(absent, "key", "left"))
    missing = tagged.where("absent").drop("absent").withColumn("reason", F.lit("missing"))
    there = tagged.where("absent is null and at is not null").drop("absent")

    alive = F.expr("born is not null and (died is null or died > born)")
    marks = lives.select("key", F.explode(F.array(
        F.when(alive, F.struct(F.col("born").alias("at"), F.lit(1).alias("live"), F.lit(0).alias("dead"))),
        F.when(F.col("died").isNotNull(), F.struct(F.col("died").alias("at"), F.when(alive, -1).otherwise(0).alias("live"), F.lit(1).alias("dead"))),
    )).alias("_m")).where("_m is not null").select("key", "_m.*").groupBy("key", "at").agg(F.sum("live").alias("live"), F.sum("dead").alias("dead"))
    marks = marks.join(there.select("key").distinct(), "key", "left_semi")
    times = there.groupBy("key", "at").agg(F.lit(0).cast("bigint").alias("live"), F.lit(0).cast("bigint").alias("dead"))
    both = marks.unionByName(times).groupBy("key", "at").agg(F.sum("live").alias("live"), F.sum("dead").alias("dead"))
    state = running_sum(both, ["at"], {"_live": "live", "_dead": "dead"}, "key", tagged.count())
    state = state.where("_live <= 0").select("key", "at", "_dead")
    gone = there.join(state, ["key", "at"]).withColumn("reason", F.when(F.col("_dead") > 0, "deleted").otherwise("late")).drop("_dead")
    cols = ["table", "row_id", "endpoint", "key", "at", "reason"]
    return missing.select(*cols).unionByName(gone.select(*cols))


def orphan_counts(found: DataFrame, refs: DataFrame) -> DataFrame:
    """Orphans and references per table, endpoint, month and reason; ``month`` is null where the time is."""
    month = F.date_format(F.timestamp_micros("at"), "yyyy-MM")
    all_ = refs.groupBy("table", "endpoint", month.alias("month")).agg(F.count(F.lit(1)).alias("n_refs"))
    bad = found.groupBy("table", "endpoint", month.alias("month"), "reason").agg(F.count(F.lit(1)).alias("n_orphans"))
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in ("table", "endpoint", "month")]
    j = bad.alias("b").join(all_.alias("a"), same[0] & same[1] & same[2])
    return j.select("b.table", "b.endpoint", "b.month", "b.reason", "b.n_orphans", "a.n_refs")
