"""How ingestion is going, per connection."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.timebins import age_seconds

# Health states and the tone each is shown in.
TONES = {"healthy": "ok", "pending": "neutral", "disabled": "neutral", "stale": "warn", "failing": "danger"}


def stale_after(poll_interval: timedelta) -> timedelta:
    return max(poll_interval * 5, timedelta(seconds=300))


def ingestion_health(connections: DataFrame, now: Column, limit: timedelta) -> DataFrame:
    """State, ages and tone of every connection, newest connection first.

    An error outranks everything but being switched off. A warning on a healthy connection changes its tone, not its
    state: rows were lost, syncing works.
    """
    seconds = int(limit.total_seconds())
    since = age_seconds(now, F.col("last_success_at"))
    state = (
        F.when(~F.col("enabled"), "disabled")
        .when(F.col("last_sync_error").isNotNull(), "failing")
        .when(F.col("last_success_at").isNull() & F.col("last_synced_at").isNotNull(), "stale")
        .when(F.col("last_success_at").isNull(), "pending")
        .when(since > seconds, "stale")
        .otherwise("healthy")
    )
    warned = (F.col("health") == "healthy") & (F.coalesce("last_ingest_warning", F.lit("")) != "")
    tone = F.when(warned, "warn")
    for name, shown in TONES.items():
        tone = tone.when(F.col("health") == name, shown)
    return (
        connections.withColumn("health", state)
        .withColumn("seconds_since_success", since)
        .withColumn("seconds_behind", age_seconds(now, F.col("watermark_start_time")))
        .withColumn("stale_after_seconds", F.lit(seconds).cast("long"))
        .withColumn("tone", tone)
        .orderBy(F.desc("created_at"), "id")
    )


def enabled_connections(connections: DataFrame) -> DataFrame:
    """Those the ingest pass serves, oldest first."""
    return connections.where("enabled").orderBy("created_at", "id")
