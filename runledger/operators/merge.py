"""Keyed merges: event upsert, bulk updates and deletes, as DataFrame in, DataFrame out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.operators.reads import first_per_connection
from runledger.schema import EVENTS

EVENT_KEY = ["connection_id", "query_id"]

# What happens to each column when a stored run is read again.
FIRST_WINS = ("query_text", "start_time")
LAST_WINS = (
    "end_time",
    "execution_time_ms",
    "wait_time_ms",
    "total_elapsed_time_ms",
    "user_agent",
    "error_type",
    "error_message",
    "is_internal",
    "ingested_at",
)
LAST_KNOWN_WINS = (
    "query_type",
    "user_name",
    "instance_type",
    "worker_id",
    "session_name",
    "bytes_uploaded",
    "bytes_downloaded",
    "bytes_spilled_to_disk",
    "fingerprint",
)


# The order of deliveries, where a batch carries it: any type that has an order.
SEQ = "seq"


def delivery_order(columns: list[str]) -> Column:
    """What orders the reads of one run: the delivery number if there is one. Without it, when it was ingested and then how
    far the run had come (a run that has ended was read after one that had not) and how much was known of it, with the
    content to settle ties."""
    if SEQ in columns:
        return F.struct(F.col(SEQ).alias("o0"))
    known = sum((F.col(name).isNotNull().cast("int") for name in EVENTS.names), F.lit(0)) + F.col("is_internal").cast("int")
    reached = [F.col("ingested_at"), F.col("end_time"), F.col("total_elapsed_time_ms"), known, F.xxhash64(*EVENTS.names)]
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(reached)])


def one_per_key(batch: DataFrame) -> DataFrame:
    """A batch with the reads of each run folded, in delivery order, by the same policies that merge it into the table.

    Two different reads of a run under one delivery number are an error: nothing tells which came last.
    """
    ordered = batch.withColumn("_order", delivery_order(batch.columns))
    if SEQ not in batch.columns:
        return fold_deliveries(ordered, "_order")
    content = F.xxhash64(*EVENTS.names)
    reads = F.collect_set(F.struct("_order", content.alias("c"))).alias("_reads")
    tied = F.expr("size(_reads) > size(array_distinct(_reads._order))")
    checked = fold_deliveries(ordered, "_order", extra=[reads]).withColumn("_tied", tied)
    message = F.concat(F.lit("different reads under one delivery number: "), F.col("connection_id"), F.lit(" "), F.col("query_id"))
    fine = F.when(F.col("_tied"), F.raise_error(message).cast("boolean")).otherwise(True)
    return checked.where(fine).select(*EVENTS.names)


def merged_column(name: str, old: Column, new: Column, matched: Column) -> Column:
    if name in LAST_WINS:
        return F.when(matched, new).otherwise(old)
    if name in LAST_KNOWN_WINS:
        return F.coalesce(new, old)
    return old


def upsert_events(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """``stored`` after ``batch``. Every batch row finds its stored row by key or becomes a new one; a key may repeat in the
    batch, whose column ``seq``, if it has one, tells the order of delivery."""
    new = one_per_key(batch)
    joined = stored.select(*EVENTS.names).alias("s").join(
        new.alias("b"),
        reduce(and_, [F.col(f"s.{key}") == F.col(f"b.{key}") for key in EVENT_KEY]),
        "full_outer",
    )
    fresh, matched = F.col("s.query_id").isNull(), F.col("b.query_id").isNotNull()
    return joined.select(
        *[
            F.when(fresh, F.col(f"b.{name}"))
            .otherwise(merged_column(name, F.col(f"s.{name}"), F.col(f"b.{name}"), matched))
            .alias(name)
            for name in EVENTS.names
        ]
    )


def fold_deliveries(deliveries: DataFrame, seq: str, keys: Sequence[str] = (), extra: Sequence[Column] = ()) -> DataFrame:
    """The event table that results from upserting every delivery in ``seq`` order, in one partial aggregate.

    For rebuilding a table from kept raw reads. A key read any number of times is folded on the map side first. ``keys``
    are further columns that a run never changes, ``extra`` further aggregates.
    """
    order = F.col(seq)

    def last_known(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), order)).alias(name)

    folded = deliveries.groupBy(*EVENT_KEY, *keys).agg(
        *[F.min_by(name, order).alias(name) for name in FIRST_WINS],
        F.max_by(F.struct(*LAST_WINS), order).alias("_last"),
        *[last_known(name) for name in LAST_KNOWN_WINS],
        *extra,
    )
    added = [name for name in folded.columns if name not in EVENTS.names and name != "_last"]
    return folded.select(*[F.col(f"_last.{name}").alias(name) if name in LAST_WINS else name for name in EVENTS.names], *added)


def folded_into(stored: DataFrame, batch: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each row of ``stored`` with the row of its key in ``batch`` merged into it; rows of other keys are left out. Both
    have the columns ``keys``, which are the same for a run. Filters on them, the key and the start reach ``stored``."""
    both = [*EVENT_KEY, *keys]
    joined = stored.select(*EVENTS.names, *keys).alias("s").join(
        batch.withColumn("_matched", F.lit(True)).alias("b"),
        reduce(and_, [F.col(f"s.{name}") == F.col(f"b.{name}") for name in both]),
        "left",
    )
    matched = F.coalesce("b._matched", F.lit(False))
    merged = [merged_column(name, F.col(f"s.{name}"), F.col(f"b.{name}"), matched).alias(name) for name in EVENTS.names]
    return joined.select(*merged, *[F.col(f"s.{name}") for name in keys])


def pending_fingerprints(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Events without a fingerprint: all, or the newest of each connection."""
    waiting = events.where(F.col("fingerprint").isNull()).select(*EVENT_KEY, "query_text", "start_time")
    return first_per_connection(waiting, [F.desc("start_time"), F.asc("query_id")], limit)


def backfill_fingerprints(events: DataFrame, assignments: DataFrame) -> DataFrame:
    """Sets the fingerprints of ``assignments`` (connection_id, query_id, fingerprint), leaving other rows alone."""
    assigned = assignments.select(*EVENT_KEY, F.col("fingerprint").alias("_assigned"))
    return (
        events.join(assigned, EVENT_KEY, "left")
        .withColumn("fingerprint", F.coalesce("_assigned", "fingerprint"))
        .select(*events.columns)
    )


def purge(rows: DataFrame, connections: DataFrame) -> DataFrame:
    """``rows`` without those of the given connections; apply to every table that hangs off a connection."""
    return rows.join(connections.select(F.col("id").alias("connection_id")), "connection_id", "left_anti")
