"""Queries for incremental evaluation (R1-R5), as a drained stream where the operator is one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trivane.plans.registry import query
from trivane.session import shared_dir
from trivane.streaming import incremental as I
from trivane.views import view


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def r01_stream_upsert(spark, d):
    """Events that land in a folder file by file, upserted by user; the newest event of each user remains."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = view(spark, d, "events").select("user_id", "event_type", "event_id")
    events.repartition(6).write.parquet(f"{base}/landing")
    stream = I.read_stream(spark, f"{base}/landing", events.schema, files_per_batch=2)
    I.upsert(stream, f"{base}/target", f"{base}/checkpoint").awaitTermination()
    return I.latest(spark, f"{base}/target", ["user_id"], [F.desc("event_id")])


@query("SELECT candidate_id FROM candidates WHERE candidate_id NOT IN (SELECT candidate_id FROM candidates WHERE status = 'confirmed')")
def r03_resume(spark, d):
    c = view(spark, d, "candidates")
    return I.remaining(c.select("candidate_id"), c.where("status = 'confirmed'"), ["candidate_id"])


@query("WITH l AS (SELECT base_id, operator, count(*) FILTER (status IN ('rejected', 'error')) AS failures, count(*) AS attempts FROM candidates GROUP BY ALL) SELECT base_id, operator, failures, attempts FROM l WHERE failures < 3")
def r04_retry_ledger(spark, d):
    ledger = I.attempts(view(spark, d, "candidates"), ["base_id", "operator"], F.col("status").isin("rejected", "error"))
    return I.retryable(ledger, ledger, ["base_id", "operator"])


@query("SELECT base_id, CAST(arg_max(points, [CASE WHEN candidate_id % 2 = 0 THEN 1 ELSE 0 END, candidate_id]) AS BIGINT) AS points, count(*) FILTER (candidate_id % 2 = 1) = 0 AS added, coalesce(min(candidate_id) FILTER (candidate_id % 2 = 1), min(candidate_id)) AS pos FROM candidates GROUP BY base_id")
def r05_merged_summary(spark, d):
    c = view(spark, d, "candidates").select("base_id", "points", F.col("candidate_id").alias("pos"))
    return I.merged_summary(c.where("pos % 2 = 1"), c.where("pos % 2 = 0"), "base_id")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def r06_windowed_counts(spark, d):
    return I.windowed_counts(view(spark, d, "events"), "ts", "event_type")
