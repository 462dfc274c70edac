"""Chunking, log, stream and end-to-end queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from vintagraph.operators import chunking as C
from vintagraph.operators import graph as G
from vintagraph.operators import retrieval as R
from vintagraph.plans import graphs, search
from vintagraph.plans.registry import Registry
from vintagraph.session import checkpoint_dir
from vintagraph.sources.readers import parse_steps
from vintagraph.sources.tables import table
from vintagraph.streaming import stateful as S

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _work(s) -> str:
    return os.path.join(checkpoint_dir(s).rstrip("/"), f"stream-{uuid.uuid4().hex}")


@query("SELECT doc_id id, c::INT chunk, c * 500 AS \"start\", substr(text, c * 500 + 1, 500) \"text\" FROM (SELECT doc_id, text, unnest(range((length(text) - 1) // 500 + 1)) c FROM documents WHERE length(text) > 0)")
def chunk_fixed(s, d):
    return C.fixed(search.docs(s, d))


@query()
def chunk_sliding(s, d):
    return C.chunked(search.docs(s, d), C.slide, "sliding")


@query()
def chunk_sentences(s, d):
    return C.chunked(search.docs(s, d), C.pack, "sentences")


@query()
def chunk_legal(s, d):
    return C.legal(search.docs(s, d)).select("id", "article", "n_lines", F.md5("text").alias("h"))


_LINE = "strftime(ts, '%Y-%m-%d %H:%M:%S') || ' | [session_' || user_id || '] ' || event_type || ': ' || printf('%.2f', value) || '초'"


@query("SELECT user_id::VARCHAR AS \"session\", event_type step, count(*) n, sum(round(round(value, 2) * 100)::BIGINT)::BIGINT centis, min(round(value, 2)) lo, max(round(value, 2)) hi FROM events GROUP BY 1, 2")
def step_log_report(s, d):
    """Log lines are written from the events, parsed back and reported."""
    e = table(s, d, "events")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" | [session_"), "user_id", F.lit("] "), "event_type", F.lit(": "), F.format_string("%.2f", F.round("value", 2)), F.lit("초"))
    p = parse_steps(e.select(line.alias("value")))
    g = p.groupBy(F.substring_index("session", "_", -1).alias("session"), "step")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("seconds") * 100).cast("bigint")).alias("centis"), F.min("seconds").alias("lo"), F.max("seconds").alias("hi"))


def _stream(s, d):
    t = table(s, d, "events")
    path = f"{d}/events.parquet"
    # a stream reads a folder; a single file is given by its own name as a pattern
    at = s.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    return s.readStream.schema(t.schema).parquet(path if folder else path + "*").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT date_trunc('hour', ts)::VARCHAR AS \"start\", event_type, count(*) n, round(avg(value), 6) mean FROM events GROUP BY 1, 2")
def stream_hourly(s, d):
    w = S.windowed(_stream(s, d), "ts", "1 hour", None, "1 day", "value", ["event_type"])
    r = S.run_to_table(w, f"t{uuid.uuid4().hex}", "complete", _work(s))
    return r.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query("""WITH RECURSIVE e AS (SELECT user_id, value x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) n FROM events WHERE value IS NOT NULL),
f AS (SELECT user_id, n, x::DOUBLE s, 0.0::DOUBLE v FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, 0.2 * x + 0.8 * s, 0.2 * abs(x - s) + 0.8 * v FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, n, round(s, 6) score, round(v, 6) volatility FROM (SELECT DISTINCT ON (user_id) * FROM f ORDER BY user_id, n DESC)""")
def stream_ema(s, d):
    """The state of every user after the whole stream; each user's rows of a micro-batch are taken in order of time."""
    r = S.run_to_table(S.ema_state(_stream(s, d), "user_id", "ts", "value"), f"t{uuid.uuid4().hex}", "update", _work(s))
    last = r.groupBy("user_id").agg(F.max_by(F.struct("n", "score", "volatility"), "n").alias("x")).select("user_id", "x.*")
    return last.withColumn("score", F.round("score", 6)).withColumn("volatility", F.round("volatility", 6))


@query("SELECT user_id, min(event_id) event_id FROM events GROUP BY 1")
def stream_append_once(s, d):
    """The stream is appended twice; the store holds every key once."""
    work = _work(s)
    for k in range(2):
        S.append_once(_stream(s, d).select("user_id", "event_id"), f"{work}/store", ["user_id"], ["event_id"], f"{work}/c{k}").awaitTermination()
    return s.read.parquet(f"{work}/store")


@query(search._RR + ", g AS (SELECT qid, id, score, \"rank\" FROM rk WHERE score >= 0.41 OR \"rank\" = 1) SELECT qid, id answer_id, round(score, 5) confidence FROM g WHERE \"rank\" = 1")
def ask_pipeline(s, d):
    """Retrieve, fuse, rerank, cut at the threshold, answer with the best passage: one lazy plan over all questions."""
    r = R.rerank(search.with_text(s, d, search.fused(s, d)))
    return r.where("rank = 1").select("qid", F.col("id").alias("answer_id"), F.round("score", 5).alias("confidence"))


@query(graphs._FLOW + """, w AS (SELECT src a, dst b, [src, dst] AS path, greatest(weight, 0.01) strength, sign, 1 n FROM e
UNION ALL SELECT a, e.dst, list_append(path, e.dst), strength * greatest(weight, 0.01), w.sign * e.sign, n + 1 FROM w JOIN e ON e.src = w.b WHERE n < 3 AND NOT list_contains(path, e.dst)),
kk AS (SELECT a, b, strength, sign, n, array_to_string(path, '>') p, row_number() OVER (PARTITION BY a, b ORDER BY n, path, strength DESC, sign) r FROM w WHERE a <> b)
SELECT a src, b dst, count(*) n_paths, round(sum(strength), 6) total FROM kk WHERE r <= 10 GROUP BY 1, 2""")
def scenario_paths(s, d):
    f = graphs.flows(s, d)
    nodes = f.select("src").union(f.select("dst")).distinct()
    pairs = nodes.join(nodes.withColumnRenamed("src", "dst")).where("src <> dst")
    p = G.simple_paths(f, pairs, 3, first=10)
    return p.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_paths"), F.round(F.sum("strength"), 6).alias("total"))


@query("""WITH k AS (SELECT event_id, ts, row_number() OVER (ORDER BY event_id) r FROM events WHERE event_id IS NOT NULL) SELECT CASE WHEN r <= 500 THEN 1 WHEN r <= 1000 THEN 2 ELSE 3 END "fetch", count(*) n, min(event_id) AS "first", max(event_id) AS "last" FROM k GROUP BY 1""")
def cursor_fetches(s, d):
    """Three fetches from a source, each from the cursor that the one before left: 500, 500 and the rest."""
    e, cursor, out = table(s, d, "events").select("event_id", "ts"), None, None
    for n, limit in ((1, 500), (2, 500), (3, None)):
        f = S.since(e, "event_id", cursor, limit).agg(F.lit(n).alias("fetch"), F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))
        row = f.first()
        cursor = row["last"] if row["n"] else cursor
        out = f if out is None else out.unionByName(f)
    return out.where("n > 0")
