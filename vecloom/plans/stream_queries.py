"""Registered queries that replay a table as a stream and return the final state."""

from __future__ import annotations

from vecloom.registry import Registry
from vecloom.streaming import jobs

REG = Registry()


@REG.query("SELECT q.vec_id AS subscriber, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id WHERE similarity >= 0.3")
def stream_subscription(spark, sf_dir):
    return jobs.subscription(spark, sf_dir)


@REG.query("SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def stream_cdc_apply(spark, sf_dir):
    return jobs.apply_changes(spark, sf_dir)


@REG.query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_view(spark, sf_dir):
    return jobs.view(spark, sf_dir)


@REG.query("SELECT DISTINCT md5(text) AS digest FROM conversations WHERE text IS NOT NULL")
def stream_seen_set(spark, sf_dir):
    """A connector that passes on each text once, whatever the batch it comes in."""
    return jobs.seen_once(spark, sf_dir)


@REG.query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def stream_ingestion(spark, sf_dir):
    """Bulk ingestion: every batch of the queue is flushed to the table as it comes."""
    return jobs.ingested(spark, sf_dir)
