"""Timestamps, durations and bucket grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.plans.params import TimeRange, micros


def bin_start(ts: Column, span: TimeRange) -> Column:
    """The start of the bucket that holds ``ts``, counted from the start of the range."""
    width = span.bucket_seconds * 1_000_000
    at = F.unix_micros(ts)
    return F.timestamp_micros(at - F.pmod(at - F.lit(micros(span.start)), F.lit(width)))


def bucket_grid(keys: DataFrame, span: TimeRange) -> DataFrame:
    """Every bucket of the range for every key row. The end is exclusive, so there are about sixty per key."""
    width = span.bucket_seconds * 1_000_000
    starts = F.sequence(F.lit(micros(span.start)), F.lit(micros(span.end) - 1), F.lit(width))
    return keys.withColumn("bucket_start", F.explode(F.transform(starts, F.timestamp_micros)))


def interval_ms(interval: Column) -> Column:
    """A day-time interval as whole milliseconds."""
    interval = interval.cast("interval day to second")
    seconds = (
        F.extract(F.lit("DAY"), interval) * 86400
        + F.extract(F.lit("HOUR"), interval) * 3600
        + F.extract(F.lit("MINUTE"), interval) * 60
        + F.extract(F.lit("SECOND"), interval)
    )
    return (seconds * 1000).cast("long")


def age_seconds(now: Column, at: Column) -> Column:
    """Whole seconds since ``at``, never negative; null when ``at`` is null."""
    elapsed = F.floor((F.unix_micros(now) - F.unix_micros(at)) / F.lit(1_000_000))
    return F.when(at.isNotNull(), F.greatest(elapsed, F.lit(0))).cast("long")
