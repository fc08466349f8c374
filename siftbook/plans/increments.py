"""Restartable jobs over the event files, run to the end of what has landed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftbook.operators.evaluation import valid_reviews
from siftbook.plans.registry import Tables, query
from siftbook.session import scratch_path
from siftbook.streaming import incremental as K


def _events(t: Tables) -> DataFrame:
    return K.landed(t.spark, t.folder, t.events.schema, "events.parquet")


@query("k1_resume", "SELECT event_id, event_type FROM events")
def _(t: Tables) -> DataFrame:
    out, checkpoint = scratch_path(t.spark, "k1"), scratch_path(t.spark, "k1-checkpoint")
    for _run in range(2):  # the second run finds nothing new
        K.process_new(_events(t).select("event_id", "event_type"), out, checkpoint)
    return t.spark.read.parquet(out)


@query("k2_upsert_by_key", "SELECT user_id, min(event_id) AS first_id, arg_max(event_type, event_id) AS status, max(event_id) AS updated_at FROM events GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    log, checkpoint = scratch_path(t.spark, "k2"), scratch_path(t.spark, "k2-checkpoint")
    rows = _events(t).select("user_id", "event_id", F.col("event_id").alias("first_id"), F.col("event_type").alias("status"), F.col("event_id").alias("updated_at"))
    K.append_log(rows, log, checkpoint)
    return K.upserted(t.spark, log, "user_id", "event_id", ["first_id"], ["status", "updated_at"])


@query("k3_seen_before", "SELECT min(event_id) AS event_id, user_id || event_type AS key FROM events GROUP BY key")
def _(t: Tables) -> DataFrame:
    log, checkpoint = scratch_path(t.spark, "k3"), scratch_path(t.spark, "k3-checkpoint")
    K.keep_unseen(_events(t).select("event_id", F.concat("user_id", "event_type").alias("key")), log, checkpoint, "event_id", ["key"])
    return K.read_log(t.spark, log).select("event_id", "key")


@query("k4_running_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t: Tables) -> DataFrame:
    out, checkpoint = scratch_path(t.spark, "k4"), scratch_path(t.spark, "k4-checkpoint")
    K.running_counts(_events(t), "event_type", out, checkpoint)
    return K.latest_counts(t.spark, out)


@query("k4_target_stop", "SELECT count(*) AS n, count(*) >= 100 AS reached FROM events WHERE event_type = 'purchase'")
def _(t: Tables) -> DataFrame:
    out, checkpoint = scratch_path(t.spark, "k4"), scratch_path(t.spark, "k4-checkpoint")
    K.running_counts(_events(t), "event_type", out, checkpoint)
    return K.target_reached(K.latest_counts(t.spark, out), "event_type", "purchase", 100)


@query("k4_first_accepted", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' ORDER BY event_id LIMIT 100")
def _(t: Tables) -> DataFrame:
    log, checkpoint = scratch_path(t.spark, "k4-log"), scratch_path(t.spark, "k4-checkpoint")
    K.collect_until(_events(t).select("event_id", "user_id", "event_type"), "event_type", "purchase", 100, log, scratch_path(t.spark, "k4"), checkpoint)
    return K.first_accepted(K.read_log(t.spark, log), "event_type", "purchase", "event_id", 100).select("event_id", "user_id")


@query("k5_review_upsert", "SELECT user_id AS qid, event_type AS reviewer, CASE WHEN arg_max(value, event_id) > 50 THEN 'good' ELSE 'wrong_key' END AS verdict FROM events WHERE value <= 150 AND user_id IN (SELECT c_custkey FROM customer) GROUP BY user_id, event_type")
def _(t: Tables) -> DataFrame:
    log, checkpoint = scratch_path(t.spark, "k5"), scratch_path(t.spark, "k5-checkpoint")
    # customers stand for the known questions; high values carry a verdict nobody knows
    verdict = F.when(F.col("value") > 150, "maybe").when(F.col("value") > 50, "good").otherwise("wrong_key")
    reviews = _events(t).select(F.col("user_id").alias("qid"), F.col("event_type").alias("reviewer"), "event_id", verdict.alias("verdict"), F.col("props").alias("notes"))
    known = valid_reviews(reviews, t.customer.select(F.col("c_custkey").alias("qid")))
    K.append_log(known.select(F.struct("qid", "reviewer").alias("key"), "event_id", "verdict"), log, checkpoint)
    state = K.upserted(t.spark, log, "key", "event_id", [], ["verdict"])
    return state.select("key.qid", "key.reviewer", "verdict")
