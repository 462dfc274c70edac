"""The most similar vectors of every vector (problem 4): probed lists with an adaptive dimension scan.

Vectors are scaled to length 1, rotated at random (the same for all) and put into the lists of their nearest
centres. Every vector probes the lists nearest to it. Within a list its partial distances to all members are taken
over the first block of rotated columns; a hypothesis test abandons members whose distance, judged by the columns
seen so far, lies beyond the k-th best known, and the next blocks are computed for the others only. The k-th best
known comes from a first scan of the vector's own list.

Exact copies are one vector with several ids. Lists are cut into member and query parts of bounded size, so a list
that holds a third of all vectors is many tasks; no part of a list is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintagraph.session import cut, small

#: Vectors that fit the centres at most (a sample by hash), fewest of them a centre, and rounds of the fit. Lists grow with
#: the root of the number of vectors up to SAMPLE / EACH; beyond FLAT of them centres have two levels.
SAMPLE, EACH, ROUNDS, FLAT = 200_000, 8, 12, 1024
#: Lists each vector probes, members and queries a task, columns a block, strictness of the test.
PROBES, MEMBERS, QUERIES, COLUMNS, EPSILON = 24, 4096, 4096, 16, 3.0


def usable(rows: DataFrame, id_: str, vec: str, dims: int) -> DataFrame:
    """id, v: the rows whose vector has ``dims`` finite values, not all zero; a repeated id counts once (the greatest vector)."""
    ok = F.col(vec).isNotNull() & (F.size(vec) == dims)
    finite = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vec, lambda x: x != 0)
    return rows.where(ok & F.col(id_).isNotNull()).where(finite).select(F.col(id_).alias("id"), F.col(vec).cast("array<float>").alias("v")).groupBy("id").agg(F.max("v").alias("v"))


def rotation(dims: int, seed: int = 20) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def centres(x: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means; empty centres are drawn anew."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), n, replace=False)]
    for _ in range(ROUNDS):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-12), x[rng.choice(len(x), n)])
    return c.astype(np.float32)


class Centres:
    """The centres of the lists; many are reached through a level of coarse ones."""

    def __init__(self, x: np.ndarray, n: int):
        self.coarse = None
        if n <= FLAT:
            self.fine = centres(x, n)
            return
        c = centres(x, round(n**0.5))
        near = np.argmax(x @ c.T, axis=1)
        parts = [x[near == i] for i in range(len(c))]
        fine = [centres(p, max(1, min(len(p), round(n * len(p) / len(x))))) for p in parts if len(p)]
        self.coarse = c[[i for i, p in enumerate(parts) if len(p)]]
        self.fine = np.concatenate(fine)
        self.start = np.r_[0, np.cumsum([len(f) for f in fine])]

    def __len__(self) -> int:
        return len(self.fine)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest lists of each row, nearest first."""
        if self.coarse is None:
            return self._top(x @ self.fine.T, n)
        cells = self._top(x @ self.coarse.T, min(len(self.coarse), max(8, n)))
        score = np.full((len(x), len(self.fine)), -2.0, dtype=np.float32)
        for c in np.unique(cells):
            rows = np.flatnonzero((cells == c).any(axis=1))
            a, b = self.start[c], self.start[c + 1]
            score[rows, a:b] = x[rows] @ self.fine[a:b].T
        return self._top(score, n)

    @staticmethod
    def _top(s: np.ndarray, n: int) -> np.ndarray:
        top = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.argsort(-s, axis=1)
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1), 1)


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float32).reshape(-1, dims)


def scan(q: np.ndarray, m: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, member, squared distance) not abandoned; ``bound`` is each query's k-th best squared distance."""
    dims = q.shape[1]
    limit = bound[:, None]
    a, b = q[:, :COLUMNS], m[:, :COLUMNS]
    part = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    keep = part * (dims / COLUMNS) <= limit * (1 + EPSILON / np.sqrt(COLUMNS)) ** 2 + 1e-6
    i, j = np.nonzero(keep)
    d = part[i, j]
    for at in range(COLUMNS, dims, COLUMNS):
        if not len(i):
            break
        step = q[i, at : at + COLUMNS] - m[j, at : at + COLUMNS]
        d = d + np.einsum("ij,ij->i", step, step)
        seen = at + COLUMNS
        ok = d * (dims / seen) <= bound[i] * (1 + (EPSILON / np.sqrt(seen) if seen < dims else 0)) ** 2 + 1e-6
        i, j, d = i[ok], j[ok], d[ok]
    return i, j, d


def _best(i: np.ndarray, j: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Of each query the places of its k nearest pairs."""
    o = np.lexsort((j, d, i))
    s = i[o]
    rank = np.arange(len(o)) - np.searchsorted(s, s, side="left")
    return o[rank < k]


def nearest(spark: SparkSession, rows: DataFrame, id_: str, vec: str, k: int = 5, dims: int = 64, probes: int = PROBES, asked: Column | None = None) -> DataFrame:
    """id, other, similarity, rank: the k nearest others of each usable vector by cosine, ties to the smaller id.

    Null, short, zero and non-finite vectors take no part. Fewer than k others give fewer rows. With no more lists
    than ``probes`` the result is exact up to the test. ``asked``: a condition on ``id``; only such vectors ask, all are
    searched.
    """
    # a vector is known by two hashes, so that no arrays are compared or joined
    base = cut(usable(rows, id_, vec, dims).select("id", "v", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"), F.coalesce(F.lit(True) if asked is None else asked, F.lit(False)).alias("ask")))
    first = Window.partitionBy("a", "b").orderBy("id")
    # copies: the k + 1 smallest ids of a vector are all that can be anyone's neighbours; the limit works before the shuffle
    heads = base.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1).groupBy("a", "b").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.max("v").alias("v"))
    asks = base.groupBy("a", "b").agg(F.max("ask").alias("ask"))
    heads = cut(heads.join(asks, ["a", "b"]))
    rot = rotation(dims)

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy()).astype(np.float64)
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rot
                yield pd.DataFrame({"g": [i[0] for i in b["ids"]], "ids": b["ids"], "ask": b["ask"], "x": [r.tobytes() for r in x.astype(np.float32)]})

    groups = cut(heads.select("ids", "v", "ask").mapInPandas(prepare, "g bigint, ids array<bigint>, ask boolean, x binary"))
    n = groups.count()
    if n == 0:
        return spark.createDataFrame([], "id bigint, other bigint, similarity double, rank int")
    lists = int(max(1, min(round(n**0.5), SAMPLE / EACH, n)))
    sample = groups.select("g", "x").orderBy(F.xxhash64("g")).limit(SAMPLE).toPandas()
    c = Centres(_matrix(sample["x"], dims).copy(), lists)
    lists = len(c)
    shared = spark.sparkContext.broadcast(c)
    near_n = min(probes, lists)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 512):
                p = b.iloc[at : at + 512]
                top = shared.value.nearest(_matrix(p["x"], dims), near_n)
                yield p.assign(near=list(top.astype(np.int32)))

    placed = cut(groups.mapInPandas(assign, "g bigint, ids array<bigint>, ask boolean, x binary, near array<int>"))

    def pairs(queries: DataFrame, lists_of, bounded: bool) -> DataFrame:
        """Candidates of the queries in the given lists, at most k for a query and part of a list."""
        asked = queries.select("g", "x", "bound", F.explode(lists_of).alias("list"))
        members = placed.select("g", "ids", "x", F.col("near")[0].alias("list"))
        sizes = members.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("m")).join(asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("q")), "list")
        sizes = F.broadcast(cut(sizes))  # one row a list, at most SAMPLE / EACH
        side = lambda df, own, other: df.join(sizes, "list").withColumn(own, F.pmod(F.xxhash64("g"), F.col(own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        a = side(asked, "q", "m").select("list", "m", "q", "g", "x", F.col("bound").cast("float").alias("bound"), F.lit(None).cast("array<bigint>").alias("ids"))
        b = side(members, "m", "q").select("list", "m", "q", "g", "x", F.lit(None).cast("float").alias("bound"), "ids")

        def work(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            mem = g["ids"].notna().to_numpy()
            mg, qg = g[mem], g[~mem]
            if not len(mg) or not len(qg):
                return pd.DataFrame(columns=["g", "ids", "d"])
            m, q, gid, qid = _matrix(mg["x"], dims), _matrix(qg["x"], dims), mg["g"].to_numpy(), qg["g"].to_numpy()
            bound = qg["bound"].to_numpy(dtype=np.float32)
            out = []
            for at in range(0, len(q), 256):
                qq, ii = q[at : at + 256], qid[at : at + 256]
                if bounded:
                    i, j, d = scan(qq, m, bound[at : at + 256])
                else:
                    full = np.maximum(0, 2 - 2 * (qq @ m.T))
                    near = np.argpartition(full, min(k, len(m) - 1), axis=1)[:, : k + 1]
                    i, j = np.repeat(np.arange(len(qq)), near.shape[1]), near.ravel()
                    d = full[i, j]
                other = ii[i] != gid[j]
                i, j, d = i[other], j[other], d[other]
                s = _best(i, j, d, k)
                i, j = i[s], j[s]
                exact = (qq[i].astype(np.float64) * m[j].astype(np.float64)).sum(1)
                out.append(pd.DataFrame({"g": ii[i], "ids": mg["ids"].to_numpy()[j], "d": 2 - 2 * exact}))
            return pd.concat(out)

        return a.unionByName(b).groupBy("list", "m", "q").applyInPandas(work, "g bigint, ids array<bigint>, d double")

    unbounded = placed.where("ask").withColumn("bound", F.lit(8.0))
    ranked = Window.partitionBy("g").orderBy("d", F.col("ids")[0])
    home = cut(pairs(unbounded, F.array(F.col("near")[0]), False).withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= k).drop("_r"))
    if near_n > 1:
        kth = home.groupBy("g").agg(F.count(F.lit(1)).alias("_n"), F.max("d").alias("_d")).select("g", F.when(F.col("_n") >= k, F.col("_d")).alias("_d"))
        bounded = placed.where("ask").join(kth, "g", "left").withColumn("bound", F.coalesce("_d", F.lit(8.0)))
        found = home.unionByName(pairs(bounded, F.slice("near", 2, near_n), True))
    else:
        found = home
    best = found.withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= k)
    lists_of = best.groupBy("g").agg(F.collect_list(F.struct("d", "ids")).alias("c"))
    # candidates of a vector: its own copies, then those of its neighbours, by distance and id
    whole = placed.where("ask").select("g", "ids").join(lists_of, "g", "left")
    flat = F.flatten(F.transform(F.coalesce("c", F.array().cast("array<struct<d:double,ids:array<bigint>>>")), lambda s: F.transform(s["ids"], lambda i: F.named_struct(F.lit("d"), s["d"], F.lit("id"), i))))
    mine = F.transform("ids", lambda i: F.named_struct(F.lit("d"), F.lit(0.0), F.lit("id"), i))
    cand = whole.select(F.explode("ids").alias("_head"), F.slice(F.array_sort(F.concat(mine, flat)), 1, k + 1).alias("c"), "g")
    table_ = cand.where("_head = g").select("g", "c")
    member = base.where("ask").select("id", "a", "b").join(small(heads.select("a", "b", F.col("ids")[0].alias("g"))), ["a", "b"]).select("id", "g")
    out = member.join(table_, "g").select("id", F.posexplode(F.slice(F.filter("c", lambda s: s["id"] != F.col("id")), 1, k)).alias("rank", "n"))
    return out.select("id", F.col("n.id").alias("other"), (1 - F.col("n.d") / 2).alias("similarity"), (F.col("rank") + 1).alias("rank"))
