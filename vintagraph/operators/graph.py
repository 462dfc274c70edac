"""Signed, weighted graphs as edge tables: src, dst, rel, sign (1, -1 or 0), weight.

Traversals run level by level over DataFrames: the frontier is joined to the edges, and each level is cut to the
shared folder, so plans stay short. Depth is bounded by a parameter and weak paths are pruned where the operator
says so; nothing else is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintagraph.session import cut, small

#: Least weight of an edge in a product, decay per hop, pruning and reporting limits of propagation.
FLOOR, DECAY, PRUNE, REPORT = 0.01, 0.9, 0.1, 0.15


def neighbours(edges: DataFrame, direction: str = "out") -> DataFrame:
    """node, other, rel, sign, weight for out, in or both directions."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "rel", "sign", "weight")
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "rel", "sign", "weight")
    return {"out": out, "in": back}.get(direction) if direction != "both" else out.unionByName(back)


def simple_paths(edges: DataFrame, pairs: DataFrame, hops: int, first: int | None = None) -> DataFrame:
    """src, dst, path, n, strength, sign of the simple paths of at most ``hops`` edges between the given pairs (src, dst).

    strength is the product of the weights (each at least FLOOR), sign the product of the signs; parallel edges give one
    path each. ``first`` keeps that many per pair, shortest first, then by path and strength.
    """
    e = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.greatest("weight", F.lit(FLOOR)).alias("_w"), F.col("sign").alias("_g"))
    front = pairs.select("src", "dst").distinct().select("src", "dst", F.array("src").alias("path"), F.lit(1.0).alias("strength"), F.lit(1).alias("sign"))
    done = None
    for n in range(1, hops + 1):
        step = front.join(e, F.element_at("path", -1) == F.col("_s")).where(~F.array_contains("path", F.col("_d")))
        step = cut(step.select("src", "dst", F.concat("path", F.array("_d")).alias("path"), (F.col("strength") * F.col("_w")).alias("strength"), (F.col("sign") * F.col("_g")).cast("int").alias("sign")))
        hit = step.where(F.element_at("path", -1) == F.col("dst")).withColumn("n", F.lit(n))
        done = hit if done is None else done.unionByName(hit)
        front = step.where(F.element_at("path", -1) != F.col("dst"))
    if first is not None:
        w = Window.partitionBy("src", "dst").orderBy("n", "path", F.col("strength").desc(), "sign")
        done = done.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= first).drop("_r")
    return done


def all_paths(edges: DataFrame, hops: int) -> DataFrame:
    """src, dst, path, n, strength, sign as in ``simple_paths``, of all pairs that a path of at most ``hops`` edges joins."""
    e = cut(edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.greatest("weight", F.lit(FLOOR)).alias("_w"), F.col("sign").alias("_g")))
    front = e.select(F.col("_s").alias("src"), F.array("_s").alias("path"), F.lit(1.0).alias("strength"), F.lit(1).alias("sign")).distinct()
    done = None
    for n in range(1, hops + 1):
        step = front.join(small(e), F.element_at("path", -1) == F.col("_s")).where(~F.array_contains("path", F.col("_d")))
        front = cut(step.select("src", F.concat("path", F.array("_d")).alias("path"), (F.col("strength") * F.col("_w")).alias("strength"), (F.col("sign") * F.col("_g")).cast("int").alias("sign")))
        hit = front.select("src", F.element_at("path", -1).alias("dst"), "path", F.lit(n).alias("n"), "strength", "sign")
        done = hit if done is None else done.unionByName(hit)
    return done


def path_verdict(paths: DataFrame) -> DataFrame:
    """Per pair: sums of positive and negative strengths, their net, the sign beyond +-0.05, confidence and conflicts."""
    pos, neg = F.sum(F.when(F.col("sign") > 0, F.col("strength")).otherwise(0.0)), F.sum(F.when(F.col("sign") < 0, F.col("strength")).otherwise(0.0))
    g = paths.groupBy("src", "dst").agg(pos.alias("pos"), neg.alias("neg"), F.count_if(F.col("sign") > 0).alias("_p"), F.count_if(F.col("sign") < 0).alias("_n"))
    net, total = F.col("pos") - F.col("neg"), F.col("pos") + F.col("neg")
    sign = F.when(total == 0, "unknown").when(net > 0.05, "+").when(net < -0.05, "-").otherwise("neutral")
    conflicts = F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_n")).otherwise(0)
    return g.select("src", "dst", "pos", "neg", sign.alias("sign"), F.least(F.lit(1.0), F.abs(net) / F.greatest(total, F.lit(0.01))).alias("confidence"), conflicts.alias("conflicts"))


def direct(edges: DataFrame, pairs: DataFrame, order: list[str]) -> DataFrame:
    """The direct edge of each pair, by the first relation of ``order`` that it has, then by weight."""
    rank = F.coalesce(*[F.when(F.col("rel") == r, F.lit(i)) for i, r in enumerate(order)], F.lit(len(order)))
    j = edges.join(pairs.select("src", "dst").distinct(), ["src", "dst"])
    best = F.min(F.struct(rank.alias("_r"), (-F.col("weight")).alias("_w"), "rel", "sign", "weight")).alias("_b")
    return j.groupBy("src", "dst").agg(best).select("src", "dst", "_b.rel", "_b.sign", "_b.weight")


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """seed, node, level: every node reached from each seed within ``depth`` hops, at its first level (the seed is level 0)."""
    e = edges.select(F.col("src").alias("_s"), F.col("dst").alias("node")).distinct()
    seen = front = cut(seeds.select("seed", F.col("seed").alias("node")).distinct().withColumn("level", F.lit(0)))
    for n in range(1, depth + 1):
        step = front.select("seed", F.col("node").alias("_s")).join(e, "_s").select("seed", "node").distinct()
        front = cut(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("level", F.lit(n)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def propagate(edges: DataFrame, seeds: DataFrame, depth: int = 3, prune: float = PRUNE, report: float = REPORT) -> DataFrame:
    """seed, node, effect: signed effects summed over all walks that do not come back to a node, DECAY per hop.

    A walk is given up when its effect falls under ``prune``; effects of at least ``report`` are returned.
    """
    e = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), (F.col("sign") * F.col("weight") * DECAY).alias("_f"))
    front = seeds.select("seed").distinct().select("seed", F.array("seed").alias("path"), F.lit(1.0).alias("x"))
    total = None
    for _ in range(depth):
        step = front.join(e, F.element_at("path", -1) == F.col("_s")).where(~F.array_contains("path", F.col("_d")))
        front = cut(step.select("seed", F.concat("path", F.array("_d")).alias("path"), (F.col("x") * F.col("_f")).alias("x")).where(F.abs("x") >= prune))
        here = front.groupBy("seed", F.element_at("path", -1).alias("node")).agg(F.sum("x").alias("effect"))
        total = here if total is None else total.unionByName(here)
    return total.groupBy("seed", "node").agg(F.sum("effect").alias("effect")).where(F.abs("effect") >= report)


def two_hop_shock(edges: DataFrame, seeds: DataFrame, fan: int = 2) -> DataFrame:
    """seed, node, hop, impact: magnitude times strength; the second hop counts half and follows the ``fan`` strongest edges of a node.

    ``seeds``: seed, magnitude.
    """
    e = edges.select(F.col("src").alias("_s"), F.col("dst").alias("node"), "rel", (F.col("sign") * F.col("weight")).alias("_f"), "weight")
    one = seeds.join(e, F.col("seed") == F.col("_s")).select("seed", "node", F.lit(1).alias("hop"), (F.col("magnitude") * F.col("_f")).alias("impact"))
    w = Window.partitionBy("_s").orderBy(F.col("weight").desc(), "node", "rel")
    top = e.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= fan).select("_s", F.col("node").alias("_n"), "_f")
    two = one.join(top, F.col("node") == F.col("_s")).where("_n <> seed").select("seed", F.col("_n").alias("node"), F.lit(2).alias("hop"), (F.col("impact") * F.col("_f") * 0.5).alias("impact"))
    return one.unionByName(two).groupBy("seed", "node", "hop").agg(F.sum("impact").alias("impact"))


def levels(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """node, level of an acyclic graph: the longest path to it, however long. Raises if there is a cycle.

    Nodes whose edges in are all worked off make the next layer (Kahn); a node is worked off once. ``depth``: raise for
    longer paths too.
    """
    e = cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("open"))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    left = cut(nodes.join(into, "node", "left").select("node", F.coalesce("open", F.lit(0).cast("bigint")).alias("open")))
    out, n = None, 0
    while not left.isEmpty():
        front = cut(left.where("open = 0").select("node").withColumn("level", F.lit(n)))
        if depth is not None and n > depth:
            raise ValueError(f"paths longer than {depth}")
        if front.isEmpty():
            raise ValueError("nodes wait for one another: the graph has a cycle")
        done = front.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("k"))
        left = cut(left.where("open > 0").join(done, "node", "left").select("node", (F.col("open") - F.coalesce("k", F.lit(0))).alias("open")))
        out, n = front if out is None else out.unionByName(front), n + 1
    return nodes.withColumn("level", F.lit(0)).where("false") if out is None else out


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree, degree."""
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    g = both.where("node is not null").groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return g.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def digest(edges: DataFrame, hubs: int = 10) -> DataFrame:
    """One row: nodes, edges, relation types and the md5 of the sorted ids of the top hubs (ties by id)."""
    d = degrees(edges)
    top = d.orderBy(F.col("degree").desc(), "node").limit(hubs).agg(F.md5(F.array_join(F.array_sort(F.collect_list("node")), ",")).alias("hubs"))
    e = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("rel").alias("n_rels"))
    return d.agg(F.count(F.lit(1)).alias("n_nodes")).join(e).join(top)


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, labels, props (map): labels of the newer row replace, props are merged, the newer value winning."""
    j = old.alias("o").join(new.alias("n"), "id", "full_outer")
    keep = F.map_filter("o.props", lambda k, _: ~F.coalesce(F.map_contains_key("n.props", k), F.lit(False)))
    props = F.when(F.col("n.props").isNull(), F.col("o.props")).when(F.col("o.props").isNull(), F.col("n.props")).otherwise(F.map_concat(keep, "n.props"))
    return j.select("id", F.coalesce("n.labels", "o.labels").alias("labels"), props.alias("props"))


def dependents(specs: DataFrame, changed: DataFrame, feature: str = "feature_id", inputs: str = "input_series") -> DataFrame:
    """kind, id: what a change of series invalidates, down the chain series -> feature -> features that read it."""
    e = specs.select(F.explode(inputs).alias("src"), F.col(feature).alias("dst"))
    r = reach(e, changed.select(F.col("id").alias("seed")), 3)
    return r.select("node", "level").distinct().groupBy("node").agg(F.min("level").alias("level"))
