"""Queries that drain streams of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docvigil.operators import blocks as B
from docvigil.plans.registry import query, select
from docvigil.streaming import logs as L


def _events(spark, sf_dir):
    return L.stream_table(spark, sf_dir, "events", L.EVENTS)


@query("x1_stream_once", "SELECT DISTINCT user_id, event_type FROM events")
def x1(spark, sf_dir):
    return L.drain(L.stream_once(_events(spark, sf_dir).select("user_id", "event_type", "ts"), ["user_id", "event_type"]).select("user_id", "event_type"), "once")


@query("x1_record_once", "SELECT user_id, event_type, event_id, event_id <> first_value(event_id) OVER w AS repeated, first_value(event_id) OVER w AS first_event_id, first_value(value) OVER w AS first_value, first_value(props) OVER w AS first_props FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def x1_record(spark, sf_dir):
    return L.drain(L.stream_record_once(_events(spark, sf_dir), ["user_id", "event_type"], ["value", "props"]), "recorded")


@query("x2_stream_conflicts", "SELECT user_id, event_id FROM (SELECT *, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events) WHERE event_type <> f")
def x2(spark, sf_dir):
    return L.drain(L.stream_conflicts(_events(spark, sf_dir), "user_id", "event_type"), "conflicts")


@query("x3_stream_jobs")
def x3(spark, sf_dir):
    return L.drain(L.stream_jobs(L.lifecycle(_events(spark, sf_dir))), "jobs")


@query("x4_stream_chain", """WITH RECURSIVE o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
    c AS (SELECT user_id, event_id, seq, '' AS previous_hash, sha256('|1|' || event_id || '|' || event_type) AS event_hash FROM o WHERE seq = 1
    UNION ALL SELECT o.user_id, o.event_id, o.seq, c.event_hash, sha256(c.event_hash || '|' || o.seq || '|' || o.event_id || '|' || o.event_type) FROM c JOIN o ON o.user_id = c.user_id AND o.seq = c.seq + 1) SELECT * FROM c""")
def x4(spark, sf_dir):
    return L.drain(L.stream_chain(_events(spark, sf_dir).withColumnRenamed("event_type", "action"), "user_id"), "chain")


_REVIEW = "SELECT event_id, ts, user_id, event_id % 5 AS actor, CASE event_id % 4 WHEN 0 THEN 'edit' WHEN 1 THEN 'needs_fix' ELSE 'approve' END AS action, CAST(event_id % 3 AS STRING) AS hash FROM events"


@query("x5_stream_reviews", f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM ({_REVIEW})), j AS (SELECT a.user_id, a.event_id, a.hash, a.actor, max(CASE WHEN p.action = 'edit' THEN p.seq END) AS last, arg_max(p.hash, p.seq) FILTER (WHERE p.action = 'edit') AS latest, max(CASE WHEN p.action = 'needs_fix' THEN p.seq END) AS fix, coalesce(bool_or(p.action = 'edit' AND p.actor = a.actor), false) AS same
    FROM e a LEFT JOIN e p ON a.user_id = p.user_id AND p.seq < a.seq WHERE a.action = 'approve' GROUP BY ALL)
    SELECT user_id, event_id, concat_ws('; ', CASE WHEN fix > coalesce(last, 0) THEN 'needs fix' END, CASE WHEN same THEN 'same actor' END, CASE WHEN last IS NULL THEN 'no edit' END, CASE WHEN latest <> hash THEN 'stale text' END) AS against FROM j""")
def x5(spark, sf_dir):
    n = F.col("event_id")
    e = _events(spark, sf_dir).select("event_id", "ts", "user_id", (n % 5).alias("actor"), F.when(n % 4 == 0, "edit").when(n % 4 == 1, "needs_fix").otherwise("approve").alias("action"), (n % 3).cast("string").alias("hash"))
    return L.drain(L.stream_reviews(e, "user_id"), "reviews")


@query("x7_stream_review_queue", "SELECT doc_id, count(*) AS blocks, count(CASE WHEN trim(t) = '' OR (doc_id * 7 + i * 13) % 41 + 60 < 80 THEN 1 END) AS to_review FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) GROUP BY doc_id")
def x7(spark, sf_dir):
    docs = L.stream_table(spark, sf_dir, "documents", "doc_id long, text string, lang string, source string, n_chars long")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    sure = ((F.col("doc_id") * 7 + F.col("idx") * 13) % 41 + 60) / 100
    blocks = lines.select("doc_id", "idx", "text", F.lit(72.0).alias("x"), sure.alias("confidence"), (sure < 0.8).alias("low_confidence"))

    def count(df):
        return B.review_gate(df).groupBy("doc_id").agg(F.count("text").alias("blocks"), F.count_if("requires_review").alias("to_review"))

    return L.stream_review_queue(blocks, count, "queue")


_ITEMS = """SELECT doc_id, CAST(ln AS BIGINT) AS block_id, CAST(ln * 13 % 41 + doc_id * 7 % 41 < 12 AS BOOLEAN) AS requires_review FROM (SELECT doc_id, n_chars, l.k AS ln FROM documents CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) l) x WHERE n_chars > ln * 400"""
_DECIDED = "SELECT doc_id, CAST(doc_id % 4 AS BIGINT) AS block_id FROM documents WHERE doc_id % 3 = 0"


@query("x7_running_counts", f"SELECT source, count(*) AS blocks, count(CASE WHEN requires_review THEN 1 END) AS to_review, count(CASE WHEN requires_review AND NOT EXISTS (SELECT 1 FROM ({_DECIDED}) c WHERE c.doc_id = i.doc_id AND c.block_id = i.block_id) THEN 1 END) AS waiting FROM documents d JOIN ({_ITEMS}) i ON i.doc_id = d.doc_id GROUP BY source")
def x7_counts(spark, sf_dir):
    """A stream of documents against batch tables of their blocks and of decisions, counted by source in update mode."""
    docs = L.stream_table(spark, sf_dir, "documents", "doc_id long, text string, lang string, source string, n_chars long").select("doc_id", "source")
    items = L.review_items(docs, select(spark, sf_dir, _ITEMS), select(spark, sf_dir, _DECIDED))
    return L.keep_latest(L.running_counts(items, ["source"]), ["source"], "counts")
