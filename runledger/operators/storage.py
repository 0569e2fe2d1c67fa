"""Storage measurements: append, newest sample per database, run rate."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions.pricing import storage_cost
from runledger.operators.reads import tiers
from runledger.schema import STORAGE_BYTES

SAMPLE_KEY = ["connection_id", "database_name", "computed_at"]
_MAX_LONG = 2**63 - 1


def new_samples(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` whose (connection, database, time) is not stored yet."""
    return batch.dropDuplicates(SAMPLE_KEY).join(existing.select(*SAMPLE_KEY), SAMPLE_KEY, "left_anti")


def append_samples(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert if absent."""
    return existing.unionByName(new_samples(existing, batch))


def latest_samples(samples: DataFrame) -> DataFrame:
    """The newest sample per database. Map tasks keep one row per database before the shuffle."""
    newest = Window.partitionBy("connection_id", "database_name").orderBy(F.desc("computed_at"))
    return samples.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") == 1).drop("_rank")


def total_bytes() -> Column:
    """Sum of the four categories; an overflow stays at the largest long."""
    wide = reduce(add, [F.col(name).cast("decimal(20,0)") for name in STORAGE_BYTES])
    return F.least(wide, F.lit(_MAX_LONG).cast("decimal(20,0)")).cast("long")


def _sized(samples: DataFrame, connections: DataFrame) -> DataFrame:
    sized = latest_samples(samples).withColumn("total_bytes", total_bytes())
    return sized.join(tiers(connections), "connection_id").select(
        "connection_id",
        "database_name",
        *STORAGE_BYTES,
        "total_bytes",
        storage_cost("total_bytes").alias("estimated_monthly_cost_usd"),
        "computed_at",
    )


def storage_by_database(samples: DataFrame, connections: DataFrame) -> DataFrame:
    """Newest sample of each database with its size and monthly cost, largest first."""
    return _sized(samples, connections).orderBy("connection_id", F.desc("total_bytes"), "database_name")


def storage_summary(samples: DataFrame, connections: DataFrame) -> DataFrame:
    """Per connection: bytes held, monthly run rate and the newest measurement; zeros and null before the first one."""
    sums = (
        _sized(samples, connections)
        .groupBy("connection_id")
        .agg(
            F.sum("total_bytes").alias("total_bytes"),
            F.sum("estimated_monthly_cost_usd").alias("estimated_monthly_cost_usd"),
            F.max("computed_at").alias("computed_at"),
        )
    )
    return tiers(connections).select("connection_id").join(sums, "connection_id", "left").select(
        "connection_id",
        F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"),
        F.coalesce("estimated_monthly_cost_usd", F.lit(0.0)).alias("estimated_monthly_cost_usd"),
        "computed_at",
    )
