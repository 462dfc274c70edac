"""Attributes as known at event time (problem 1): point-in-time matches against versioned histories.

Every attribute keeps its own narrow history (attribute, time, known-at, value); an event is matched with
each of its attributes separately and the matches are pivoted back, so that attributes that update at
different times never force wide versions.

The match is two-dimensional: the last version with time <= event time *and* known-at <= event known-at.
Versions and events are sorted together by attribute, time and known-at over range partitions of even size
(``blocks.in_order``), so neither a hot attribute nor an instant with very many versions makes a large task. In a
partition every event climbs a tree of least known-at times to its match. Only what an event's own partition does not
hold is looked up in an earlier one of the same attribute, found by the least known-at of each. No task reads a whole
history, and nothing is dropped, however late versions arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagraph.operators.blocks import in_order
from vintagraph.session import cut, small

#: Known-at of an event that knows nothing.
NEVER = -(2**63)


def last_known(k: np.ndarray, before: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Of each query the last index below ``before`` whose ``k`` is at most ``bound``, else -1.

    ``levels[l]`` holds the least k of runs of 2**l; a query climbs to the first run before it that has a hit, then
    descends in it. All queries move together.
    """
    levels = [k]
    while len(levels[-1]) > 1:
        x = levels[-1]
        x = np.append(x, np.iinfo(np.int64).max) if len(x) % 2 else x
        levels.append(np.minimum(x[::2], x[1::2]))
    pos, node = before.astype(np.int64), np.full(len(before), -1, dtype=np.int64)
    depth = np.zeros(len(before), dtype=np.int64)
    for lv, least in enumerate(levels):
        at = np.flatnonzero((node < 0) & ((pos >> lv) & 1 == 1))
        run = (pos[at] >> lv) - 1
        hit = least[run] <= bound[at]
        node[at[hit]], depth[at[hit]] = run[hit], lv
        pos[at[~hit]] -= 1 << lv
    for lv in range(len(levels) - 1, 0, -1):
        at = np.flatnonzero((node >= 0) & (depth == lv))
        right = 2 * node[at] + 1
        below = levels[lv - 1]
        ok = (right < len(below)) & (below[np.minimum(right, len(below) - 1)] <= bound[at])
        node[at], depth[at] = np.where(ok, right, right - 1), lv - 1
    return node


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row an event (kind 1) with its matches in the partition, and one (kind 0) on the partition's last attribute."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    tb = pa.Table.from_batches(parts).combine_chunks()
    code = tb["_a"].combine_chunks().dictionary_encode().indices.to_numpy()
    t, k, o = (tb[c].to_numpy() for c in ("_t", "_k", "_o"))
    version = o == 0
    vt, vk = t[version], k[version]
    seen = np.cumsum(version)  # versions up to each row
    start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    first = np.repeat(seen[start] - version[start], np.diff(np.r_[start, len(code)]))  # versions before the attribute
    at = np.flatnonzero(~version)
    q, low = seen[at], first[at]
    j = last_known(vk, q, k[at]) if len(vk) else np.full(len(at), -1, dtype=np.int64)
    known, final = np.where((j >= low) & (k[at] > NEVER), j, -1), np.where(q > low, q - 1, -1)
    pid = tb["_p"][0].as_py()

    def column(x: np.ndarray, hit: np.ndarray) -> pa.Array:
        return pa.array(x[hit] if len(x) else np.zeros(len(hit), dtype=np.int64), mask=hit < 0, type=pa.int64())

    n = len(at)
    # earlier partitions may hold more of the first attribute only
    cols = [pa.array(np.full(n, 1, dtype=np.int32)), pa.array(np.full(n, pid, dtype=np.int32)), tb["_i"].combine_chunks().take(pa.array(at)), tb["_a"].combine_chunks().take(pa.array(at)), pa.array(k[at]), column(vt, known), column(vk, known), column(vt, final), column(vk, final), pa.array(code[at] == code[0])]
    names = ["kind", "_p", "_i", "_a", "_k", "known_t", "known_k", "final_t", "final_k", "first"]
    if n:
        yield pa.RecordBatch.from_arrays(cols, names=names)
    own = int(first[-1])
    if len(vk) > own:
        one = lambda x, kind: pa.array([x], type=kind)
        last = [one(0, pa.int32()), one(pid, pa.int32()), one(None, pa.int64()), one(tb["_a"][len(code) - 1].as_py(), tb.schema.field("_a").type), one(int(vk[own:].min()), pa.int64()), one(None, pa.int64()), one(None, pa.int64()), one(int(vt[-1]), pa.int64()), one(int(vk[-1]), pa.int64()), one(False, pa.bool_())]
        yield pa.RecordBatch.from_arrays(last, names=names)


def _elsewhere(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """The matches of events in one earlier partition of their attribute."""
    asks = group["_i"].notna().to_numpy()
    v = group[~asks].sort_values(["_t", "_k"])
    e = group[asks]
    j = last_known(v["_k"].to_numpy(dtype=np.int64), np.full(len(e), len(v)), e["_k"].to_numpy(dtype=np.int64))
    hit = v.iloc[j]
    return pd.DataFrame({"_i": e["_i"].to_numpy().astype(np.int64), "_t2": hit["_t"].to_numpy(), "_k2": hit["_k"].to_numpy()})


def match_known(events: DataFrame, history: DataFrame, event: str, attribute: str, t: str, known: str) -> DataFrame:
    """For each (event, attribute): which version was known then (``known_*``) and which in the end (``final_*``).

    ``events``: columns ``event``, ``attribute``, ``t`` (event time) and ``known`` (time of knowledge), bigints.
    ``history``: ``attribute``, ``t``, ``known``. A version with a null in these takes no part. An event with a null
    attribute or time matches nothing; with a null ``known`` it has no known version. Result: one row per row of
    ``events`` with ``event``, ``attribute``, ``known_t``, ``known_k``, ``final_t``, ``final_k`` (null where there is
    no such version). Only times travel here; ``with_payload`` fetches what the matched versions hold.
    """
    kind = history.schema[attribute].dataType
    asked = cut(events.select(F.monotonically_increasing_id().alias("_i"), F.col(event).alias("_e"), F.col(attribute).cast(kind).alias("_a"), F.col(t).alias("_t"), F.coalesce(known, F.lit(NEVER)).alias("_k")))
    h = history.select(F.col(attribute).alias("_a"), F.col(t).alias("_t"), F.col(known).alias("_k")).where("_a is not null and _t is not null and _k is not null")
    h = h.distinct()  # repeated deliveries could not be told apart by the sort
    both = h.select("_a", "_t", F.lit(0).alias("_o"), "_k", F.lit(None).cast("bigint").alias("_i")).unionByName(asked.where("_a is not null and _t is not null").select("_a", "_t", F.lit(1).alias("_o"), "_k", "_i"))
    # versions of an event's own time come before it
    line = cut(in_order(both, ["_a", "_t", "_o", "_k", "_i"], history.count() + asked.count()).withColumn("_p", F.spark_partition_id()))
    names = "known_t bigint, known_k bigint, final_t bigint, final_k bigint"
    got = cut(line.mapInArrow(_search, f"kind int, _p int, _i bigint, _a {kind.simpleString()}, _k bigint, {names}, first boolean"))
    # the partitions of an attribute that ends or goes on beyond them: one row each, of the attributes that need them
    lists = got.where("kind = 0").groupBy("_a").agg(F.sort_array(F.collect_list(F.struct("_p", F.col("_k").alias("least"), "final_t", "final_k"))).alias("_s"))
    open_ = got.where("kind = 1 and first and (final_t is null or known_t is null)").select("_i", "_a", "_k", "_p", "final_t", "known_t")
    past = open_.join(small(cut(lists)), "_a").withColumn("_s", F.filter("_s", lambda x: x["_p"] < F.col("_p")))
    with_k = F.when(F.col("known_t").isNull() & (F.col("_k") > NEVER), F.try_element_at(F.filter("_s", lambda x: x["least"] <= F.col("_k")), F.lit(-1))["_p"])
    past = cut(past.where("size(_s) > 0").select("_i", "_a", "_k", with_k.alias("_q"), F.try_element_at("_s", F.lit(-1)).alias("_l")))
    wanted = past.where("_q is not null").select("_a", F.col("_q").alias("_p"), "_k", "_i")
    places = small(cut(wanted.select("_a", "_p").distinct()))
    held = line.where("_o = 0").select("_a", "_p", "_t", "_k", "_i").join(places, ["_a", "_p"], "left_semi").unionByName(wanted.select("_a", "_p", F.lit(None).cast("bigint").alias("_t"), "_k", "_i"))
    there = held.groupBy("_a", "_p").applyInPandas(_elsewhere, "_i bigint, _t2 bigint, _k2 bigint")
    late = past.select("_i", F.col("_l.final_t").alias("_ft"), F.col("_l.final_k").alias("_fk")).join(there, "_i", "left")
    hits = got.where("kind = 1").join(small(cut(late)), "_i", "left")
    picked = [F.coalesce("known_t", "_t2").alias("known_t"), F.coalesce("known_k", "_k2").alias("known_k"), F.coalesce("final_t", "_ft").alias("final_t"), F.coalesce("final_k", "_fk").alias("final_k")]
    out = asked.select("_i", F.col("_e").alias(event), F.col("_a").alias(attribute)).join(hits.select("_i", *picked), "_i", "left")
    return out.drop("_i")


def with_payload(matches: DataFrame, history: DataFrame, attribute: str, t: str, known: str, payload: str, every: bool = False) -> DataFrame:
    """Add ``known_payload``, what the known versions of ``matches`` hold; matches without a known version are left out, or
    with ``every`` kept with null.

    Versions with equal (attribute, t, known) count as one, with the largest payload.
    """
    h = history.select(F.col(attribute), F.col(t).alias("known_t"), F.col(known).alias("known_k"), F.col(payload).alias("known_payload"))
    wanted = matches.where("known_t is not null")
    keys = small(cut(wanted.select(attribute, "known_t", "known_k").distinct()))
    held = h.join(keys, [attribute, "known_t", "known_k"]).groupBy(attribute, "known_t", "known_k").agg(F.max("known_payload").alias("known_payload"))
    return (matches if every else wanted).join(held, [attribute, "known_t", "known_k"], "left" if every else "inner")


def pivot_known(matches: DataFrame, event: str, attribute: str, value: str = "known_payload", every: bool = False) -> DataFrame:
    """The matches of an event put back side by side: ``attributes`` maps attribute to matched value.

    An attribute without a version is left out of the map, or with ``every`` mapped to null.
    """
    pair = F.when((F.lit(every) | F.col("known_t").isNotNull()) & F.col(attribute).isNotNull(), F.struct(F.col(attribute), F.col(value)))
    return matches.groupBy(event).agg(F.map_from_entries(F.sort_array(F.collect_set(pair))).alias("attributes"))

