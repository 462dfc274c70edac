"""Encoding with a public byte-level BPE vocabulary (problem 8).

Texts are cut into words by the vocabulary's published pattern; each word's bytes form a doubly linked list, and a
priority queue of merge ranks joins neighbours, skipping entries that have become stale. Words repeat, so each
worker remembers the ids of those it has seen. Decoding concatenates the vocabulary's strings.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from vintagraph.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern of this vocabulary's words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a worker remembers before it starts anew (memory only, results don't depend on it).
REMEMBERED = 200_000


def load(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes to id, which is also the merge rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    part = [word[i : i + 1] for i in range(n)]
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    queue = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
    heapify(queue)
    while queue:
        _, i, joined = heappop(queue)
        j = right[i]
        if part[i] is None or j < 0 or part[i] + part[j] != joined:
            continue  # stale
        part[i], part[j] = joined, None
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b >= 0 and (r := ranks.get(part[a] + part[b])) is not None:
                heappush(queue, (r, a, part[a] + part[b]))
    return [ranks[p] for p in part if p is not None]


class Encoder:
    """Encodes texts; keeps the ids of words seen."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.words, self.seen = ranks, regex.compile(PATTERN), {}

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; a null or empty text has none. Lone surrogates count as U+FFFD."""
        if not text:
            return np.empty(0, dtype=np.int32)
        seen, out = self.seen, []
        for w in self.words.findall(text):
            ids = seen.get(w)
            if ids is None:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                ids = np.array(merge(w.encode("utf-8", "replace"), self.ranks), dtype=np.int32).tobytes()
                if len(w) <= 64:
                    seen[w] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), dtype=np.int32)


def decode(ids: list[int], ranks: dict[bytes, int]) -> str:
    """The text of a list of ids."""
    by_id = {v: k for k, v in ranks.items()}
    return b"".join(by_id[i] for i in ids).decode("utf-8")


_ENCODERS: dict[int, Encoder] = {}


def encode_column(spark: SparkSession, docs: DataFrame, id_: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """``id_`` and ``ids`` (array<int>) of every row of ``docs``; a null or empty text gives an empty list.

    The vocabulary is read on the driver and broadcast (50,256 entries, under 2 MB).
    """
    shared = spark.sparkContext.broadcast(load(path))
    key = hash((path, id(shared)))
    two = spread(docs.select(id_, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _ENCODERS.setdefault(key, Encoder(shared.value))
        for b in batches:
            rows = b.num_rows
            for at in range(0, rows, 512):  # bounds what one output batch holds
                part = b.slice(at, 512)
                ids = [enc.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = np.concatenate(ids) if ids else np.empty(0, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_, "ids"])

    schema = StructType([StructField(id_, docs.schema[id_].dataType), StructField("ids", ArrayType(IntegerType()))])
    return two.mapInArrow(run, schema)
