"""The queries of the training-data problems 2, 4, 6, 8, 9 and 10 and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagraph.llm.answers import defects
from vintagraph.llm.leaks import leaked
from vintagraph.llm.neighbours import nearest
from vintagraph.llm.residue import recurring, residue
from vintagraph.llm.splitting import pieces
from vintagraph.llm.tokens import encode_column
from vintagraph.sources.tables import table

#: Share of an item's words from which a document holds it.
HELD = 0.5


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces(table(spark, d, "text_chunks"), "id", "content", ["page_number"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).where("piece_no = 1 and n_pieces > 1").select("id")


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar chunks of every chunk whose id is divisible by 100, against all chunks."""
    return nearest(spark, table(spark, d, "text_chunks"), "id", "embedding", asked=F.col("id") % 100 == 0).select("id", "other", F.round("similarity", 5).alias("similarity"), "rank")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    n = nearest(spark, table(spark, d, "text_chunks"), "id", "embedding")
    return n.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return defects(table(spark, d, "qa_pairs"), "qa_id", "question", ["expected", "generated"])


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_column(spark, table(spark, d, "documents"), "doc_id", "text")


def p9_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every document and item with a common stretch, how much of the item it covers and the longest stretch."""
    return leaked(spark, table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_matches(spark, d).where(F.col("covered") >= HELD).select("doc_id", "item_id")


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that hold no item."""
    return table(spark, d, "documents").select("doc_id").join(p9_found(spark, d).select("doc_id").distinct(), "doc_id", "left_anti")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue(table(spark, d, "documents"), "doc_id", "text", "source").select("doc_id")


def p10_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many documents have residue of each kind."""
    r = residue(table(spark, d, "documents"), "doc_id", "text", "source")
    return r.select("doc_id", F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n_docs"))


def p10_recurring(spark: SparkSession, d: str) -> DataFrame:
    """Messages that recur in at least five sources, with their class."""
    return recurring(table(spark, d, "documents"), "doc_id", "text", "source")


_ALL = (p2_found, p2_pieces, p4_found, p4_neighbours, p6_found, p8_ids, p9_found, p9_matches, p9_clean, p10_found, p10_kinds, p10_recurring)
QUERIES = {f.__name__: f for f in _ALL}

_P9 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}_]+') w FROM documents WHERE text IS NOT NULL),
     iw AS (SELECT item_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}_]+') w FROM eval_items),
     dg AS (SELECT doc_id, unnest([list_aggregate(w[i:i + 5], 'string_agg', ' ') FOR i IN range(1, len(w) - 4)]) g FROM dw),
     ip AS (SELECT item_id, len(w) n, w, unnest(range(1, len(w) - 4)) p FROM iw),
     ig AS (SELECT item_id, n, p, list_aggregate(w[p:p + 5], 'string_agg', ' ') g FROM ip),
     m AS (SELECT DISTINCT doc_id, item_id, n, p FROM dg JOIN ig USING (g)),
     c AS (SELECT doc_id, item_id, n, least(6, coalesce(lead(p) OVER (PARTITION BY doc_id, item_id ORDER BY p) - p, 6)) k FROM m),
     f AS (SELECT doc_id, item_id FROM c GROUP BY doc_id, item_id, n HAVING sum(k) >= 0.5 * n)
"""
_P4 = """
WITH v AS (SELECT id, embedding::DOUBLE[] e FROM text_chunks WHERE embedding IS NOT NULL AND len(embedding) = 64 AND (list_max(embedding) > 0 OR list_min(embedding) < 0)),
     s AS (SELECT x.id a, y.id b, list_cosine_similarity(x.e, y.e) c FROM v x JOIN v y ON x.id <> y.id),
     r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(c, 12) DESC, b) k FROM s)
"""
SQL = {
    "p2_found": r"SELECT id FROM text_chunks WHERE length(trim(content, E' \t\r\n')) > 800",
    "p4_found": _P4 + "SELECT DISTINCT least(a, b) id_a, greatest(a, b) id_b FROM r WHERE k <= 5",
    "p9_found": _P9 + "SELECT doc_id, item_id FROM f",
    "p9_clean": _P9 + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f)",
}
