"""Evaluation texts inside training texts (problem 9), by suffix arrays over words.

The corpus is worked off in shards (runs of whole documents of one partition). A shard's words, as hashes, make one
suffix array, sorted by prefix doubling to the depth that counts; it does not depend on the test texts. Every suffix of
every test text is then looked up by binary search, all of them together, which gives all places of its stretches in
the shard. Overlapping places join to the longest verbatim stretches; a document holds an item if these cover at least
the given share of the item's words.

Test texts are cut into words where they are read and sent along in blocks of bounded size. With more than one block
the arrays are built once and kept in the shared folder; the corpus is read once however many test texts there are.
"""

from __future__ import annotations

import io
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagraph.session import cut, spread

#: Shortest stretch that counts, and words a shard and a block of test texts hold (whole texts, so a long one may pass it).
STRETCH, SHARD_WORDS, BLOCK_WORDS = 6, 600_000, 2_000_000
_WORD = re.compile(r"\w+")
_COLUMNS = ["doc", "item", "covered", "longest", "longest_at"]


def words(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, lower case, composed."""
    return _WORD.findall(unicodedata.normalize("NFC", text).lower()) if text else []


class Hashes(dict):
    """Word to hash; 0 is none of them and separates texts."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1 or 1
        return h

    def of(self, text: str | None) -> np.ndarray:
        return np.fromiter((self[w] for w in words(text)), dtype=np.int64)


def _ahead(r: np.ndarray, step: int, base: int) -> np.ndarray:
    """Keys of ``r`` with the rank ``step`` places on; 0 where either is none."""
    later = np.zeros(len(r), dtype=np.int64)
    later[: max(0, len(r) - step)] = r[step:]
    return np.where((r > 0) & (later > 0), r * base + later, 0)


class Suffixes:
    """The suffix array of a run of hashes (0 separates), sorted by the first STRETCH words; shorter suffixes are left out."""

    def __init__(self, w: np.ndarray):
        self.levels = []
        rank = self._level(w.astype(np.int64), 0, 0)
        span = 1
        while span < STRETCH:
            step = min(span, STRETCH - span)
            base = int(rank.max(initial=0)) + 1
            rank = self._level(_ahead(rank, step, base), step, base)
            span += step
        order = np.argsort(rank, kind="stable")
        self.order = order[np.searchsorted(rank[order], 1) :].astype(np.int32 if len(w) < 2**31 else np.int64)
        self.start = np.r_[0, np.cumsum(np.bincount(rank)[1:])] if len(rank) else np.zeros(1, dtype=np.int64)

    def _level(self, key: np.ndarray, step: int, base: int) -> np.ndarray:
        u, inv = np.unique(key, return_inverse=True)
        none = len(u) > 0 and u[0] == 0
        self.levels.append((step, base, u[1:] if none else u))
        return inv.astype(np.int64) + (0 if none else 1)

    def find(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From and to in ``order`` of the places of the stretch that starts at each place of ``t``."""
        r = t
        for step, base, u in self.levels:
            key = _ahead(r, step, base) if step else r
            at = np.minimum(np.searchsorted(u, key), max(0, len(u) - 1))
            r = np.where((key > 0) & (u[at] == key), at + 1, 0) if len(u) else np.zeros(len(key), dtype=np.int64)
        return np.where(r > 0, self.start[np.maximum(r - 1, 0)], 0), np.where(r > 0, self.start[np.minimum(r, len(self.start) - 1)], 0)


class Tests:
    """A block of test texts: hashes with 0 after each text, and the item and place of each of them."""

    def __init__(self, items: list[tuple]):
        self.ids = [i for i, _ in items]
        parts = [np.frombuffer(b, dtype=np.int64) for _, b in items]
        self.size = np.array([len(p) for p in parts], dtype=np.int64)
        self.words = np.concatenate([np.r_[p, 0] for p in parts]) if parts else np.zeros(0, dtype=np.int64)
        self.item = np.repeat(np.arange(len(parts)), self.size + 1)
        self.place = np.concatenate([np.arange(len(p) + 1) for p in parts]) if parts else self.words


def search(array: Suffixes, doc: np.ndarray, tests: Tests) -> pd.DataFrame:
    """doc, item (index), p (word of the item), at (place in the shard) of every stretch of STRETCH words found."""
    lo, hi = array.find(tests.words)
    t = np.flatnonzero(hi > lo)
    n = (hi - lo)[t]
    at = array.order[np.repeat(lo[t] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if len(t) else np.zeros(0, dtype=np.int64)
    return pd.DataFrame({"doc": doc[at], "item": np.repeat(tests.item[t], n), "p": np.repeat(tests.place[t], n), "at": at.astype(np.int64)})


def summarise(hits: pd.DataFrame) -> pd.DataFrame:
    """doc, item, covered (words of the item), longest (words), longest_at (place) per document and item."""
    if hits.empty:
        return pd.DataFrame(columns=_COLUMNS)
    u = hits.drop_duplicates(["doc", "item", "p"]).sort_values(["doc", "item", "p"])
    step = u["p"].shift(-1) - u["p"]
    same = (u["doc"].shift(-1) == u["doc"]) & (u["item"].shift(-1) == u["item"])
    u = u.assign(c=np.where(same, np.minimum(step.fillna(STRETCH), STRETCH), STRETCH))
    cover = u.groupby(["doc", "item"], sort=False)["c"].sum()
    h = hits.assign(d=hits["at"] - hits["p"]).sort_values(["doc", "item", "d", "p"])
    new = (h["doc"].shift() != h["doc"]) | (h["item"].shift() != h["item"]) | (h["d"].shift() != h["d"]) | (h["p"].shift() + 1 != h["p"])
    runs = h.assign(run=new.cumsum()).groupby("run").agg(doc=("doc", "first"), item=("item", "first"), n=("p", "size"), at=("at", "first"))
    best = runs.sort_values(["n", "at"], ascending=[False, True]).drop_duplicates(["doc", "item"]).set_index(["doc", "item"])
    out = cover.to_frame("covered").join(best).reset_index()
    return out.assign(longest=out["n"] + STRETCH - 1, longest_at=out["at"])[_COLUMNS]


def _shard(texts: list) -> tuple[Suffixes, np.ndarray, np.ndarray]:
    """The array of a shard, the document of each place, and where each document begins."""
    seen = Hashes()
    parts = [np.r_[seen.of(t), 0] for t in texts]
    size = np.array([len(p) for p in parts], dtype=np.int64)
    w = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return Suffixes(w), np.repeat(np.arange(len(parts)), size), np.r_[0, np.cumsum(size)][:-1]


def _found(ids: list, shard: tuple, tests: Tests) -> pd.DataFrame:
    array, doc, begins = shard
    r = summarise(search(array, doc, tests))
    k, d = r["item"].astype(int).to_numpy(), r["doc"].astype(int).to_numpy()
    return pd.DataFrame({"doc": [ids[i] for i in d], "item": [tests.ids[i] for i in k], "covered": r["covered"].to_numpy(dtype=float) / tests.size[k], "longest": r["longest"].astype(int), "longest_at": r["longest_at"].astype(int) - begins[d]})


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list]]:
    """Ids and texts of about SHARD_WORDS words at a time, whole documents."""
    ids, texts, n = [], [], 0
    for b in batches:
        for i, x in zip(b.iloc[:, 0], b.iloc[:, 1]):
            ids.append(i)
            texts.append(x)
            n += (len(x) if x else 0) // 4
            if n >= SHARD_WORDS:
                yield ids, texts
                ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def _pack(ids: list, shard: tuple) -> bytes:
    array, doc, begins = shard
    out = io.BytesIO()
    flat = {f"u{i}": u for i, (_, _, u) in enumerate(array.levels)}
    np.savez(out, ids=np.array(ids), steps=np.array([x[:2] for x in array.levels]), order=array.order, start=array.start, doc=doc, begins=begins, **flat)
    return out.getvalue()


def _unpack(data: bytes) -> tuple[list, tuple]:
    z = np.load(io.BytesIO(data), allow_pickle=True)
    array = Suffixes.__new__(Suffixes)
    array.levels = [(int(s), int(b), z[f"u{i}"]) for i, (s, b) in enumerate(z["steps"])]
    array.order, array.start = z["order"], z["start"]
    return z["ids"].tolist(), (array, z["doc"], z["begins"])


def blocks(items: DataFrame, id_: str, text: str) -> Iterator[Tests]:
    """The test texts in blocks of bounded size, read one partition at a time; repeated rows count once.

    Words are cut and hashed where the texts are read. Texts of fewer than STRETCH words are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Hashes()
        for b in batches:
            h = [seen.of(t) for t in b.iloc[:, 1]]
            keep = [len(x) >= STRETCH for x in h]
            yield pd.DataFrame({id_: b.iloc[:, 0][keep], "w": [x.tobytes() for x, k in zip(h, keep) if k]})

    rows = items.select(id_, text).where(F.col(id_).isNotNull() & F.col(text).isNotNull()).distinct()
    hashed = cut(rows.mapInPandas(run, f"{id_} {items.schema[id_].dataType.simpleString()}, w binary"))
    block, n = [], 0
    for i, w in hashed.orderBy(id_, "w").toLocalIterator():
        block.append((i, bytes(w)))
        n += len(w) // 8
        if n >= BLOCK_WORDS:
            yield Tests(block)
            block, n = [], 0
    if block:
        yield Tests(block)


def leaked(spark: SparkSession, docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """doc_id, item_id, covered (share of the item's words), longest and longest_at (words) of every pair with a common stretch.

    Null and empty texts and items of fewer than STRETCH words hold and give nothing. A text under two ids comes out
    under both. Documents are read once; no row is shuffled.
    """
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc {kinds[0]}, item {kinds[1]}, covered double, longest int, longest_at int"
    texts = spread(docs.select(doc_id, text).where(F.col(doc_id).isNotNull()))
    source, out = blocks(items, item_id, item_text), None
    tests, after = next(source, None), next(source, None)
    kept = None
    if after is not None:  # built once, read for every block

        def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for ids, part in _shards(batches):
                yield pd.DataFrame({"shard": [_pack(ids, _shard(part))]})

        kept = cut(texts.mapInPandas(build, "shard binary"))
    while tests is not None:
        shared = spark.sparkContext.broadcast(tests)  # at most BLOCK_WORDS hashes

        def direct(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for ids, part in _shards(batches):
                if len(r := _found(ids, _shard(part), shared.value)):
                    yield r

        def stored(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                for data in b["shard"]:
                    if len(r := _found(*_unpack(data), shared.value)):
                        yield r

        part = texts.mapInPandas(direct, schema) if kept is None else kept.mapInPandas(stored, schema)
        out = part if out is None else out.unionByName(part)
        tests, after = after, next(source, None)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnsRenamed({"doc": doc_id, "item": item_id})
