"""Reads and writes of append-only, versioned histories.

Rows carry a key (``series_id``), a time, the time they became known (``as_of``) and a payload. Null keys, times or
as_of are never returned by as-of reads. Ties are broken by the columns named in each docstring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class LookAheadError(ValueError):
    """A replay asked for something that was not known yet."""


def guard(requested, as_of, replay: bool = True) -> None:
    """In a replay, refuse times after ``as_of`` and reads without one."""
    if replay and as_of is None:
        raise LookAheadError("a replay needs an as-of time")
    if replay and requested is not None and requested > as_of:
        raise LookAheadError(f"{requested} lies after the as-of time {as_of}")


def newest(rows: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Of each key the row with the greatest ``order`` (then the greatest ``keep``); one shuffle with partial aggregation.

    NaN is no value: it sorts above all numbers when versions tie, and comes out as null.
    """
    best = F.max(F.struct(*order, *[c for c in keep if c not in order])).alias("_b")
    real = {c for c in [*order, *keep] if rows.schema[c].dataType.typeName() in ("double", "float")}
    held = [(safe(F.col(f"_b.{c}")) if c in real else F.col(f"_b.{c}")).alias(c) for c in dict.fromkeys([*order, *keep])]
    return rows.groupBy(*keys).agg(best).select(*keys, *held)


def as_of_read(rows: DataFrame, as_of, key: str = "series_id", t: str = "timestamp", known: str = "as_of", keep: tuple[str, ...] = ("value",), start=None, end=None) -> DataFrame:
    """The version of each (key, time) that was known at ``as_of`` (inclusive); bounds on the time are inclusive."""
    guard(None, as_of)
    r = rows.where(F.col(key).isNotNull() & F.col(t).isNotNull() & (F.col(known) <= F.lit(as_of)))
    r = r if start is None else r.where(F.col(t) >= F.lit(start))
    r = r if end is None else r.where(F.col(t) <= F.lit(end))
    return newest(r, [key, t], [known], list(keep))


def latest(rows: DataFrame, key: str = "series_id", t: str = "timestamp", known: str = "as_of", keep: tuple[str, ...] = ("value",)) -> DataFrame:
    """The last known version of each (key, time)."""
    return newest(rows.where(F.col(known).isNotNull()), [key, t], [known], list(keep))


def last_value(rows: DataFrame, as_of, key: str = "series_id", t: str = "timestamp", known: str = "as_of", keep: tuple[str, ...] = ("value",), bound_time: bool = False) -> DataFrame:
    """The row of each key that is last by (time, as_of) among those known at ``as_of``; ``bound_time`` bounds the time too."""
    guard(None, as_of)
    r = rows.where(F.col(key).isNotNull() & (F.col(known) <= F.lit(as_of)))
    return newest(r if not bound_time else r.where(F.col(t) <= F.lit(as_of)), [key], [t, known], list(keep))


def versions(rows: DataFrame, key: str = "series_id", t: str = "timestamp", known: str = "as_of", keep: tuple[str, ...] = ("value",)) -> DataFrame:
    """The vintages of every (key, time) numbered by as_of; repeated deliveries count once (the greatest payload)."""
    u = newest(rows.where(F.col(known).isNotNull()), [key, t, known], list(keep), [])
    return u.withColumn("vintage", F.row_number().over(Window.partitionBy(key, t).orderBy(known)))


def append_new(store: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of ``batch`` to append: one per key (the least by ``order``), and only keys the store does not hold."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = batch.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return fresh.join(store.select(*keys).distinct(), keys, "left_anti")


def upsert(store: DataFrame, batch: DataFrame, key: list[str], keep_from_store: list[str] | None = None) -> DataFrame:
    """``store`` with the rows of ``batch`` put in by key; the columns of ``keep_from_store`` keep the stored value."""
    kept = keep_from_store or []
    other = [c for c in store.columns if c not in key]
    there = F.coalesce(F.col("b._new"), F.lit(False))
    b = batch.withColumn("_new", F.lit(True)).alias("b")
    j = b.join(store.alias("s"), key, "full_outer")
    cols = [F.coalesce(F.col(f"s.{c}"), F.col(f"b.{c}")).alias(c) if c in kept else F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in other]
    return j.select(*key, *cols)


def without_range(rows: DataFrame, key: str, ids: list[str], t: str, start, end) -> DataFrame:
    """``rows`` less those of the given keys and inclusive range (a delete is a rewrite with the filter turned round)."""
    hit = F.col(key).isin(ids) & F.col(t).between(F.lit(start), F.lit(end))
    return rows.where(~F.coalesce(hit, F.lit(False)))


def op_log_state(log: DataFrame, key: str, seq: str, op: str, keep: list[str]) -> DataFrame:
    """Replay of a journal of puts and deletes: the last operation of each key counts, deleted keys are gone."""
    return newest(log, [key], [seq], [op, *keep]).where(F.col(op) != "delete").select(key, *keep)


def fetch_state(events: DataFrame, key: list[str], t: str, ok: str, cursor: str) -> DataFrame:
    """Per key the last cursor of a success, the number of failures since and the totals."""
    good = events.where(F.col(ok)).groupBy(*key).agg(F.max(t).alias("last_success"), F.max_by(cursor, t).alias("cursor"))
    j = events.join(good, key, "left")
    since = F.count_if(~F.col(ok) & (F.col("last_success").isNull() | (F.col(t) > F.col("last_success"))))
    return j.groupBy(*key).agg(F.max("last_success").alias("last_success"), F.max("cursor").alias("cursor"), since.alias("failures_since"), F.count(F.lit(1)).alias("n_fetches"))


def running_mean(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The mean a running update arrives at; nulls do not count."""
    return rows.groupBy(*key).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def snapshot(parts: dict[str, tuple[DataFrame, str, list[str], list[str]]], as_of) -> DataFrame:
    """State of several components at ``as_of`` in one long table: component, key, payload (JSON).

    ``parts``: name -> (rows, known column, key columns, payload columns); of each key the newest version known.
    """
    guard(None, as_of)
    out = None
    for name, (rows, known, key, keep) in parts.items():
        n = newest(rows.where(F.col(known) <= F.lit(as_of)), key, [known], keep)
        part = n.select(F.lit(name).alias("component"), F.concat_ws("|", *key).alias("key"), F.to_json(F.struct(*keep)).alias("payload"))
        out = part if out is None else out.unionByName(part)
    return out


def violations(requests: DataFrame, t: str, as_of: str, kind: str) -> DataFrame:
    """Requests after their as-of time, per kind, with the rate over all requests of the kind."""
    bad = F.col(t) > F.col(as_of)
    return requests.groupBy(kind).agg(F.count_if(bad).alias("n_violations"), F.count(F.lit(1)).alias("n_requests"), F.avg(F.coalesce(bad, F.lit(False)).cast("int")).alias("rate"))


def compare_runs(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """A live and a replayed run side by side: key, both values, same (null-safe); keys of both runs only."""
    j = a.select(key, F.col(value).alias("live")).join(b.select(key, F.col(value).alias("replay")), key)
    return j.withColumn("same", F.col("live").eqNullSafe(F.col("replay")))


def safe(col: str | Column) -> Column:
    """NaN as null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.isnan(c), None).otherwise(c)


def allowed(requested: str | Column, as_of: str | Column) -> Column:
    """'ok', 'no_as_of' or 'look_ahead': what ``guard`` says of every read of a replay."""
    r, a = (F.col(x) if isinstance(x, str) else x for x in (requested, as_of))
    return F.when(a.isNull(), "no_as_of").when(r > a, "look_ahead").otherwise("ok")
