"""Reads and reports of stores beside the series: evidence, regimes, graph edits, candidates, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def state_at(states: DataFrame, at: Column, t: str, keep: list[str], key: str | None = None) -> DataFrame:
    """The state in force at ``at``: the last row at or before it, of each ``key`` if given; ties to the greatest ``keep``."""
    r = states.where(F.col(t) <= at)
    best = F.max(F.struct(t, *keep)).alias("_b")
    g = r.groupBy(key).agg(best) if key else r.agg(best).where("_b is not null")
    return g.select(*([key] if key else []), f"_b.{t}", *[F.col(f"_b.{c}").alias(c) for c in keep])


def state_stats(states: DataFrame, t: str, state: str) -> DataFrame:
    """state, n, first, last over rows with a state; a null state is counted nowhere."""
    return states.where(F.col(state).isNotNull()).groupBy(state).agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("first"), F.max(t).alias("last"))


def upsert_relations(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The relations of both, of each ``key`` the one with the greatest ``order``; the new one wins ties. Null keys stay out."""
    u = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).dropna(subset=key)
    rest = [c for c in old.columns if c not in key]
    best = F.max(F.struct(order, "_new", *[c for c in rest if c != order])).alias("_b")
    return u.groupBy(*key).agg(best).select(*key, *[F.col(f"_b.{c}").alias(c) for c in rest])


def delete_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """``edges`` (src, dst) without those that touch a node of ``gone`` (node)."""
    g = gone.select("node").distinct()
    return edges.join(g, F.col("src") == F.col("node"), "left_anti").join(g, F.col("dst") == F.col("node"), "left_anti")


def merge_candidates(lists: dict[str, DataFrame], key: list[str], score: str) -> DataFrame:
    """key, score (the best), sources (sorted): candidates of several lists, one row per key."""
    u = None
    for name, df in lists.items():
        p = df.select(*key, score, F.lit(name).alias("_s"))
        u = p if u is None else u.unionByName(p)
    return u.groupBy(*key).agg(F.max(score).alias(score), F.array_sort(F.collect_set("_s")).alias("sources"))


def with_fallback(first: DataFrame, second: DataFrame, key: str, least: int = 3) -> DataFrame:
    """All rows of ``first`` and, for keys with fewer than ``least`` of them, those of ``second``; ``origin`` tells which."""
    n = first.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    more = second.join(n.select(key), key, "left_anti")
    return first.withColumn("origin", F.lit("first")).unionByName(more.withColumn("origin", F.lit("second")))


def samples(decisions: DataFrame, rewards: DataFrame, trace: str) -> DataFrame:
    """Decisions with the reward of their trace; decisions without one are left out, the greatest of several rewards counts."""
    return decisions.join(rewards.where("reward is not null").groupBy(trace).agg(F.max("reward").alias("reward")), trace)


def last_by(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each group; the limit works before the shuffle."""
    w = Window.partitionBy(group).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def type_pair_errors(edges: DataFrame, types: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """edges (src, dst, rel) with head_type, tail_type and ``fits``: true if a rule (head type, tail type, relation) allows
    the edge, null if an end has no type. ``types``: id, type, one row an id."""
    h, t = types.select(F.col("id").alias("src"), F.col("type").alias("head_type")), types.select(F.col("id").alias("dst"), F.col("type").alias("tail_type"))
    allowed = F.array(*[F.lit("|".join(r)) for r in rules]) if rules else F.array().cast("array<string>")
    pair = F.concat(F.col("head_type"), F.lit("|"), F.col("tail_type"), F.lit("|"), F.col("rel"))
    return edges.join(h, "src", "left").join(t, "dst", "left").withColumn("fits", F.array_contains(allowed, pair))


def break_condition(value: Column, op: Column, limit: Column) -> Column:
    """Whether a condition (> >= < <=) is triggered; a missing value or another operator triggers nothing."""
    c = F.when(op == ">", value > limit).when(op == ">=", value >= limit).when(op == "<", value < limit).when(op == "<=", value <= limit)
    return F.coalesce(c, F.lit(False))


def path_breaks(paths: DataFrame, strong: float = 0.25, weak: float = 0.10) -> DataFrame:
    """src, dst, kind, edge, weight, limit: of paths with ``steps`` (array of struct edge, sign, weight) the strongest and the
    weakest positive edge of all paths of a pair, and the weight under which the conclusion breaks; ties to the smaller edge."""
    e = paths.select("src", "dst", F.explode_outer("steps").alias("s")).where("s.sign > 0").select("src", "dst", "s.edge", "s.weight")
    g = e.groupBy("src", "dst").agg(F.min(F.struct((-F.col("weight")).alias("w"), "edge")).alias("_hi"), F.min(F.struct(F.col("weight").alias("w"), "edge")).alias("_lo"))
    two = F.array(F.struct(F.lit("strongest").alias("kind"), F.col("_hi.edge").alias("edge"), (0.0 - F.col("_hi.w")).alias("weight"), F.lit(strong).alias("limit")), F.struct(F.lit("weakest").alias("kind"), F.col("_lo.edge").alias("edge"), F.col("_lo.w").alias("weight"), F.lit(weak).alias("limit")))
    return g.select("src", "dst", F.explode(two).alias("x")).select("src", "dst", "x.*")


def mentions(fragments: DataFrame, names: DataFrame) -> DataFrame:
    """id, n, entity, type: entities whose name stands in a fragment (id, n, text) as successive words.

    Names go by their number of words; fragments are cut into runs of such lengths and joined on them, so no fragment is
    held against every name. ``names``: entity, type, name.
    """
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")))
    k = names.where("name is not null").select("entity", "type", key(F.col("name")).alias("_k")).where("_k <> ''").withColumn("_w", F.size(F.split("_k", " ")))
    lengths = sorted(r[0] for r in k.select("_w").distinct().collect())  # numbers of words
    f = fragments.select("id", "n", F.split(key(F.col("text")), " ").alias("_t"))
    runs = F.flatten(F.transform(F.lit(lengths).cast("array<int>"), lambda m: F.when(F.size("_t") >= m, F.transform(F.sequence(F.lit(1), F.size("_t") - m + 1), lambda i: F.array_join(F.slice("_t", i, m), " "))).otherwise(F.array().cast("array<string>"))))
    r = f.select("id", "n", F.explode_outer(F.array_distinct(runs)).alias("_k"))
    return r.join(k, "_k").select("id", "n", "entity", "type").distinct()


def pair_mentions(found: DataFrame, polarity: DataFrame, most: int = 8) -> DataFrame:
    """head, tail, sign, n_fragments: pairs of entities named in one fragment (head before tail by id), by the sign of the
    fragment (id, n, sign). Fragments with more than ``most`` entities are lists, no statements, and give none."""
    g = found.groupBy("id", "n").agg(F.array_sort(F.collect_set("entity")).alias("_e")).where((F.size("_e") >= 2) & (F.size("_e") <= most))
    p = g.select("id", "n", F.explode("_e").alias("head"), "_e").select("id", "n", "head", F.explode("_e").alias("tail")).where("head < tail")
    return p.join(polarity, ["id", "n"]).groupBy("head", "tail", "sign").agg(F.count(F.lit(1)).alias("n_fragments"))
