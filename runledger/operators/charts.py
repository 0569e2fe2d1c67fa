"""Second-level reads over a bucket chart. A chart has at most some sixty rows per connection, so windows here are
small whatever the event table holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MEASURES = {"count": "query_count", "cost": "estimated_cost_usd"}


def latency_segments(buckets: DataFrame) -> DataFrame:
    """Runs of consecutive measured buckets. An empty bucket ends a run instead of being drawn through."""
    chart = Window.partitionBy("connection_id").orderBy("bucket_start")
    gaps = F.sum(F.when(F.col("p95_ms").isNull(), 1).otherwise(0)).over(chart)
    return (
        buckets.withColumn("_island", gaps)
        .where(F.col("p95_ms").isNotNull())
        .groupBy("connection_id", "_island")
        .agg(
            F.min("bucket_start").alias("segment_start"),
            F.max("bucket_start").alias("segment_end"),
            F.count(F.lit(1)).alias("points"),
            F.max("p95_ms").alias("max_p95_ms"),
        )
        .drop("_island")
    )


def chart_digest(buckets: DataFrame, measure: str = "count") -> DataFrame:
    """What a chart says in one row: total, first peak, failures, and how many buckets hold anything."""
    if measure not in MEASURES:
        raise ValueError("measure must be count or cost")
    value = F.col(MEASURES[measure])
    return (
        buckets.groupBy("connection_id")
        .agg(
            F.count(F.lit(1)).alias("buckets"),
            F.min("bucket_start").alias("first_bucket"),
            F.max("bucket_start").alias("last_bucket"),
            F.sum(value).alias("total"),
            F.max(value).alias("peak"),
            F.min_by("bucket_start", F.struct(-value, "bucket_start")).alias("peak_bucket"),
            F.sum("failure_count").alias("failures"),
            F.count_if(F.col("query_count") > 0).alias("populated_buckets"),
        )
    )
