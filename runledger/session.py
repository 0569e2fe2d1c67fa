"""Session settings the plans rely on, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings, so they can be applied to a session somebody else started.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Per-connection pages keep up to 5,000 rows; let the map side prune to that before the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build(master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName("runledger")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared ``spark.checkpoint.dir``.

    A machine-local folder is used only by a single-machine session that names none.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return os.path.join(tempfile.mkdtemp(prefix="spark-"), name)


# Rows that a task of costly work on each row takes at most.
ROWS_A_TASK = 50_000


def spread(rows: DataFrame) -> DataFrame:
    """Deals rows out when their source has fewer splits than there are cores, as with one file of a single row group, or so
    few that a split holds many more than ``ROWS_A_TASK`` rows. So a task stays as long as it is, however large the table.

    Meant before costly work on each row, and for tables in files, which are counted from their footers. Rows are dealt by
    their hash, for which nothing is sorted.
    """
    wanted = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))
    return rows.repartition(wanted, F.xxhash64(*rows.columns)) if rows.rdd.getNumPartitions() < wanted else rows


_FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def size_shuffles(spark: SparkSession, rows: int) -> None:
    """Lets every shuffle begin with a partition for each ``ROWS_A_TASK`` rows of the largest table at least, so that what a
    task reads and sorts does not grow with the table. Small partitions are joined again when the shuffle is read.

    The number is that of the session and only goes up."""
    known = [spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get(_FIRST_PARTITIONS, None)]
    wanted = max(-(-rows // ROWS_A_TASK), *[int(number) for number in known if number])
    spark.conf.set(_FIRST_PARTITIONS, str(wanted))
