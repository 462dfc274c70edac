"""Queries over the knowledge graph and over trade flows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vintagraph.operators import graph as G
from vintagraph.operators.references import key_of
from vintagraph.plans.registry import Registry
from vintagraph.sources.tables import table, unique

query = Registry()
QUERIES, SQL = query.queries, query.sql


def edges(s, d):
    """The relations as edges: distinct relation ids, ids normalised, sign from '+' and '-', weight the confidence."""
    r = unique(s, d, "relations", "relation_id")
    sign = F.when(F.trim("props.sign") == "+", 1).when(F.trim("props.sign") == "-", -1).otherwise(0)
    e = r.select(key_of("head_id").alias("src"), key_of("tail_id").alias("dst"), F.col("type").alias("rel"), sign.alias("sign"), F.coalesce("props.domain_conf", F.lit(0.0)).alias("weight"))
    return e.where("src is not null and dst is not null")


_E = """WITH RECURSIVE e AS (SELECT lower(trim(head_id)) src, lower(trim(tail_id)) dst, type rel, CASE trim(props.sign) WHEN '+' THEN 1 WHEN '-' THEN -1 ELSE 0 END sign, coalesce(props.domain_conf, 0.0) weight
FROM (SELECT DISTINCT ON (relation_id) * FROM relations ORDER BY relation_id) WHERE trim(head_id) <> '' AND trim(tail_id) <> '')"""
#: A small dense graph: trade flows between nations, the three strongest partners of each.
_FLOW = """WITH RECURSIVE f AS (SELECT c.n_name src, t.n_name dst, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE v, avg(l_discount) disc
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation c ON c.n_nationkey = c_nationkey JOIN nation t ON t.n_nationkey = s_nationkey
WHERE c.n_nationkey <> t.n_nationkey GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY v DESC, dst) r, max(v) OVER (PARTITION BY src) m FROM f),
e AS (SELECT src, dst, 'trade' rel, CASE WHEN ascii(substr(src, 1, 1)) % 2 = ascii(substr(dst, 1, 1)) % 2 THEN 1 ELSE -1 END sign, round(v / m, 6) weight FROM k WHERE r <= 3)"""


def flows(s, d):
    from pyspark.sql import Window

    n = table(s, d, "nation")
    l = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    # sums by key first, names afterwards: the joins with nation see 600 rows at most
    f = l.where("c_nationkey <> s_nationkey").groupBy("c_nationkey", "s_nationkey").agg(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double").alias("v"))
    f = f.join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("src")), "c_nationkey").join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("dst")), "s_nationkey")
    w = Window.partitionBy("src")
    k = f.withColumn("r", F.row_number().over(w.orderBy(F.col("v").desc(), "dst"))).withColumn("m", F.max("v").over(w)).where("r <= 3")
    sign = F.when(F.ascii(F.substring("src", 1, 1)) % 2 == F.ascii(F.substring("dst", 1, 1)) % 2, 1).otherwise(-1)
    return k.select("src", "dst", F.lit("trade").alias("rel"), sign.alias("sign"), F.round(F.col("v") / F.col("m"), 6).alias("weight"))


@query(_E + " SELECT src node, dst other, rel, sign, weight FROM e UNION ALL SELECT dst, src, rel, sign, weight FROM e")
def graph_neighbours(s, d):
    return G.neighbours(edges(s, d), "both")


@query(_E + " SELECT node, sum(o) out_degree, sum(i) in_degree, count(*) degree FROM (SELECT src node, 1 o, 0 i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1")
def graph_degrees(s, d):
    return G.degrees(edges(s, d))


@query(_E + ", g AS (SELECT node, count(*) n FROM (SELECT src node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1), h AS (SELECT node FROM g ORDER BY n DESC, node LIMIT 10) SELECT (SELECT count(*) FROM g) n_nodes, (SELECT count(*) FROM e) n_edges, (SELECT count(DISTINCT rel) FROM e) n_rels, (SELECT md5(string_agg(node, ',' ORDER BY node)) FROM h) hubs")
def degree_digest(s, d):
    return G.digest(edges(s, d))


_PATHS = _FLOW + """, w AS (SELECT src a, dst b, [src, dst] AS path, greatest(weight, 0.01) strength, sign, 1 n FROM e
UNION ALL SELECT a, e.dst, list_append(path, e.dst), strength * greatest(weight, 0.01), w.sign * e.sign, n + 1 FROM w JOIN e ON e.src = w.b WHERE n < 4 AND NOT list_contains(path, e.dst))"""


def _ends(s, d):
    n = table(s, d, "nation")
    a, b = n.where("n_regionkey = 0").select(F.col("n_name").alias("src")), n.where("n_regionkey = 1").select(F.col("n_name").alias("dst"))
    return a.join(b)


_ENDS = "(SELECT x.n_name src, y.n_name dst FROM nation x, nation y WHERE x.n_regionkey = 0 AND y.n_regionkey = 1)"


@query(_PATHS + f" SELECT a src, b dst, array_to_string(path, '>') path, n, round(strength, 8) strength, sign FROM w JOIN {_ENDS} p ON p.src = a AND p.dst = b")
def paths_bounded(s, d):
    p = G.simple_paths(flows(s, d), _ends(s, d), 4)
    return p.select("src", "dst", F.array_join("path", ">").alias("path"), "n", F.round("strength", 8).alias("strength"), "sign")


@query(_PATHS + f", q AS (SELECT a src, b dst, sum(CASE WHEN sign > 0 THEN strength ELSE 0 END) pos, sum(CASE WHEN sign < 0 THEN strength ELSE 0 END) neg, count(*) FILTER (sign > 0) np, count(*) FILTER (sign < 0) nn FROM w JOIN {_ENDS} p ON p.src = a AND p.dst = b GROUP BY 1, 2)"
       " SELECT src, dst, round(pos, 8) pos, round(neg, 8) neg, CASE WHEN pos + neg = 0 THEN 'unknown' WHEN pos - neg > 0.05 THEN '+' WHEN pos - neg < -0.05 THEN '-' ELSE 'neutral' END sign, round(least(1.0, abs(pos - neg) / greatest(pos + neg, 0.01)), 6) confidence, CASE WHEN np > 0 AND nn > 0 THEN nn ELSE 0 END conflicts FROM q")  # fmt: skip
def path_verdicts(s, d):
    v = G.path_verdict(G.simple_paths(flows(s, d), _ends(s, d), 4))
    return v.select("src", "dst", F.round("pos", 8).alias("pos"), F.round("neg", 8).alias("neg"), "sign", F.round("confidence", 6).alias("confidence"), "conflicts")


@query(_E + ", k AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY CASE rel WHEN 'affect' THEN 0 WHEN 'cause' THEN 1 ELSE 2 END, weight DESC, rel, sign) r FROM e) SELECT src, dst, rel, sign, weight FROM k WHERE r = 1")
def direct_edges(s, d):
    e = edges(s, d)
    return G.direct(e, e, ["affect", "cause"])


@query(_FLOW + """, w AS (SELECT src seed, dst node, [src, dst] AS path, sign * weight * 0.9 x, 1 n FROM e WHERE abs(sign * weight * 0.9) >= 0.1
UNION ALL SELECT seed, e.dst, list_append(path, e.dst), x * e.sign * e.weight * 0.9, n + 1 FROM w JOIN e ON e.src = w.node WHERE n < 3 AND NOT list_contains(path, e.dst) AND abs(x * e.sign * e.weight * 0.9) >= 0.1)
SELECT seed, node, round(sum(x), 6) effect FROM w GROUP BY 1, 2 HAVING abs(sum(x)) >= 0.15""")
def signed_propagation(s, d):
    f = flows(s, d)
    return G.propagate(f, f.select(F.col("src").alias("seed"))).withColumn("effect", F.round("effect", 6))


_SEEDS = "(SELECT src seed FROM e GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 10)"


@query(_E + f""", r AS (SELECT seed, seed node, 0 AS "level" FROM {_SEEDS} UNION SELECT seed, e.dst, r."level" + 1 FROM r JOIN e ON e.src = r.node WHERE r."level" < 3)
SELECT seed, node, min("level") AS "level" FROM r GROUP BY 1, 2""")
def reachability(s, d):
    e = edges(s, d)
    seeds = e.groupBy(F.col("src").alias("seed")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "seed").limit(10)
    return G.reach(e, seeds, 3)


@query(_E + f""", r AS (SELECT seed, seed node, 0 AS "level" FROM {_SEEDS} UNION SELECT seed, e.dst, r."level" + 1 FROM r JOIN e ON e.src = r.node WHERE r."level" < 2),
m AS (SELECT DISTINCT seed, node FROM r), t AS (SELECT lower(trim(id)) id, min(props.type) kind FROM entities GROUP BY 1)
SELECT seed, kind, count(*) n FROM m LEFT JOIN t ON t.id = m.node GROUP BY 1, 2""")
def reach_by_type(s, d):
    e = edges(s, d)
    seeds = e.groupBy(F.col("src").alias("seed")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "seed").limit(10)
    t = table(s, d, "entities").groupBy(key_of("id").alias("node")).agg(F.min("props.type").alias("kind"))
    return G.reach(e, seeds, 2).join(t, "node", "left").groupBy("seed", "kind").agg(F.count(F.lit(1)).alias("n"))


_DAG = "WITH RECURSIVE e AS (SELECT DISTINCT unnest(input_series) src, feature_id dst FROM feature_specs UNION SELECT feature_id, feature_type FROM feature_specs)"


def _dag(s, d):
    f = table(s, d, "feature_specs")
    return f.select(F.explode("input_series").alias("src"), F.col("feature_id").alias("dst")).union(f.select("feature_id", "feature_type")).distinct()


@query(_DAG + " SELECT src, dst FROM e")
def dependency_graph(s, d):
    return _dag(s, d)


@query(_DAG + """, r AS (SELECT DISTINCT src node, 0 AS "level" FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, r."level" + 1 FROM r JOIN e ON e.src = r.node) SELECT node, max("level") AS "level" FROM r GROUP BY 1""")
def topo_level(s, d):
    return G.levels(_dag(s, d))


@query(_DAG + """, r AS (SELECT DISTINCT series_id node, 0 AS "level" FROM observations WHERE is_revision UNION SELECT e.dst, r."level" + 1 FROM r JOIN e ON e.src = r.node WHERE r."level" < 3) SELECT node, min("level") AS "level" FROM r GROUP BY 1""")
def invalidated(s, d):
    changed = table(s, d, "observations").where("is_revision").select(F.col("series_id").alias("seed")).distinct()
    return G.reach(_dag(s, d), changed, 3).groupBy("node").agg(F.min("level").alias("level"))


@query(_FLOW + """, o AS (SELECT src seed, dst node, 1 hop, 0.5 * sign * weight impact FROM e),
t AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst, rel) r FROM e),
u AS (SELECT * FROM o UNION ALL SELECT seed, t.dst, 2, impact * t.sign * t.weight * 0.5 FROM o JOIN t ON t.src = o.node WHERE r <= 2 AND t.dst <> seed)
SELECT seed, node, hop, round(sum(impact), 6) impact FROM u GROUP BY 1, 2, 3""")
def two_hop_shock(s, d):
    f = flows(s, d)
    seeds = f.select(F.col("src").alias("seed")).distinct().withColumn("magnitude", F.lit(0.5))
    return G.two_hop_shock(f, seeds).withColumn("impact", F.round("impact", 6))


@query(_E + " SELECT count(*) n, count(*) FILTER (src = dst) self_loops, count(*) FILTER (sign = 0) unsigned FROM e")
def graph_checks(s, d):
    return edges(s, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("src = dst")).alias("self_loops"), F.count_if(F.expr("sign = 0")).alias("unsigned"))


@query("""WITH o AS (SELECT lower(trim(id)) id, arg_max(props.type, created_at) t, arg_max(props.name, created_at) n FROM entities WHERE deleted_at IS NULL GROUP BY 1)
SELECT id, t AS label, n AS "name" FROM o""")
def entity_upsert(s, d):
    e = table(s, d, "entities").where("deleted_at is null")
    newest = e.groupBy(key_of("id").alias("id")).agg(F.max_by("props", "created_at").alias("p"))
    rows = newest.select("id", F.array("p.type").alias("labels"), F.create_map(F.lit("name"), F.col("p.name")).alias("props"))
    old = e.groupBy(key_of("id").alias("id")).agg(F.min_by("props", "created_at").alias("p")).select("id", F.array("p.type").alias("labels"), F.create_map(F.lit("name"), F.col("p.name")).alias("props"))
    return G.upsert_entities(old, rows).select("id", F.col("labels")[0].alias("label"), F.col("props")["name"].alias("name"))


# The path and propagation queries over the relations, from every entity.
_WALKS = _E + """, w AS (SELECT src a, dst b, [src, dst] AS path, greatest(weight, 0.01) strength, sign, 1 n FROM e WHERE src <> dst
UNION ALL SELECT a, e.dst, list_append(path, e.dst), strength * greatest(weight, 0.01), w.sign * e.sign, n + 1 FROM w JOIN e ON e.src = w.b WHERE n < {hops} AND NOT list_contains(path, e.dst))"""


@query(_WALKS.format(hops=4) + " SELECT a src, b dst, array_to_string(path, '>') path, n, round(strength, 8) strength, sign FROM w")
def kg_paths(s, d):
    return G.all_paths(edges(s, d), 4).select("src", "dst", F.array_join("path", ">").alias("path"), "n", F.round("strength", 8).alias("strength"), "sign")


@query(_WALKS.format(hops=4) + ", q AS (SELECT a src, b dst, sum(CASE WHEN sign > 0 THEN strength ELSE 0 END) pos, sum(CASE WHEN sign < 0 THEN strength ELSE 0 END) neg, count(*) FILTER (sign > 0) np, count(*) FILTER (sign < 0) nn FROM w GROUP BY 1, 2)"
       " SELECT src, dst, round(pos, 8) pos, round(neg, 8) neg, CASE WHEN pos + neg = 0 THEN 'unknown' WHEN pos - neg > 0.05 THEN '+' WHEN pos - neg < -0.05 THEN '-' ELSE 'neutral' END sign, round(least(1.0, abs(pos - neg) / greatest(pos + neg, 0.01)), 6) confidence, CASE WHEN np > 0 AND nn > 0 THEN nn ELSE 0 END conflicts FROM q")  # fmt: skip
def kg_path_verdicts(s, d):
    v = G.path_verdict(G.all_paths(edges(s, d), 4))
    return v.select("src", "dst", F.round("pos", 8).alias("pos"), F.round("neg", 8).alias("neg"), "sign", F.round("confidence", 6).alias("confidence"), "conflicts")


@query(_WALKS.format(hops=4) + " SELECT a src, b dst, array_to_string(path, '>') path, round(0.5 + 0.8 * strength + 0.3 * 0.5 - 0.1 * n, 6) score FROM w")
def kg_path_scores(s, d):
    p = G.all_paths(edges(s, d), 4)
    return p.select("src", "dst", F.array_join("path", ">").alias("path"), F.round(0.5 + 0.8 * F.col("strength") + 0.3 * 0.5 - 0.1 * F.col("n"), 6).alias("score"))


@query(_WALKS.format(hops=3) + " SELECT a src, b dst, count(*) n_paths, count(*) FILTER (w.sign <> e.sign) n_contrary FROM w JOIN e ON e.src = a AND e.dst = b WHERE n > 1 GROUP BY 1, 2")
def kg_path_consistency(s, d):
    e = edges(s, d)
    p = G.all_paths(e, 3).where("n > 1").select("src", "dst", F.col("sign").alias("ps"))
    j = p.join(e.select("src", "dst", "sign"), ["src", "dst"])
    return j.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_paths"), F.count_if(F.col("ps") != F.col("sign")).alias("n_contrary"))


@query(_E + """, w AS (SELECT src seed, dst node, [src, dst] AS path, sign * weight * 0.9 x, 1 n FROM e WHERE src <> dst AND abs(sign * weight * 0.9) >= 0.1
UNION ALL SELECT seed, e.dst, list_append(path, e.dst), x * (e.sign * e.weight * 0.9), n + 1 FROM w JOIN e ON e.src = w.node WHERE n < 3 AND NOT list_contains(path, e.dst) AND abs(x * (e.sign * e.weight * 0.9)) >= 0.1)
SELECT seed, node, round(sum(x), 6) effect FROM w GROUP BY 1, 2 HAVING abs(sum(x)) >= 0.15""")
def kg_propagation(s, d):
    e = edges(s, d)
    return G.propagate(e, e.select(F.col("src").alias("seed"))).withColumn("effect", F.round("effect", 6))


@query(_E + """, o AS (SELECT src seed, dst node, 1 hop, 0.5 * sign * weight impact FROM e),
t AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst, rel) r FROM e),
u AS (SELECT * FROM o UNION ALL SELECT seed, t.dst, 2, impact * t.sign * t.weight * 0.5 FROM o JOIN t ON t.src = o.node WHERE r <= 2 AND t.dst <> seed)
SELECT seed, node, hop, round(sum(impact), 6) impact FROM u GROUP BY 1, 2, 3""")
def kg_two_hop_shock(s, d):
    e = edges(s, d)
    return G.two_hop_shock(e, e.select(F.col("src").alias("seed")).distinct().withColumn("magnitude", F.lit(0.5))).withColumn("impact", F.round("impact", 6))


@query(_E + """, r AS (SELECT DISTINCT src seed, src node, 0 AS "level" FROM e UNION SELECT seed, e.dst, r."level" + 1 FROM r JOIN e ON e.src = r.node WHERE r."level" < 3)
SELECT seed, node, min("level") AS "level" FROM r GROUP BY 1, 2""")
def kg_reachability(s, d):
    e = edges(s, d)
    return G.reach(e, e.select(F.col("src").alias("seed")), 3)


@query(_E + """, r AS (SELECT DISTINCT src seed, src node, 0 AS "level" FROM e UNION SELECT seed, e.dst, r."level" + 1 FROM r JOIN e ON e.src = r.node WHERE r."level" < 2),
m AS (SELECT DISTINCT seed, node FROM r), t AS (SELECT lower(trim(id)) id, min(props.type) kind FROM entities GROUP BY 1)
SELECT seed, kind, count(*) n FROM m LEFT JOIN t ON t.id = m.node GROUP BY 1, 2""")
def kg_reach_by_type(s, d):
    e = edges(s, d)
    t = table(s, d, "entities").groupBy(key_of("id").alias("node")).agg(F.min("props.type").alias("kind"))
    return G.reach(e, e.select(F.col("src").alias("seed")), 2).join(t, "node", "left").groupBy("seed", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(_WALKS.format(hops=3) + """, kk AS (SELECT a, b, strength, sign, n, row_number() OVER (PARTITION BY a, b ORDER BY n, path, strength DESC, sign) r FROM w)
SELECT a src, b dst, count(*) n_paths, round(sum(strength), 6) total FROM kk WHERE r <= 10 GROUP BY 1, 2""")
def kg_scenario_paths(s, d):
    w = Window.partitionBy("src", "dst").orderBy("n", "path", F.col("strength").desc(), "sign")
    p = G.all_paths(edges(s, d), 3).withColumn("r", F.row_number().over(w)).where("r <= 10")
    return p.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_paths"), F.round(F.sum("strength"), 6).alias("total"))
