"""One ingest pass over all connections as a set-based plan.

What a poller keeps in memory per connection (whether it is catching up, when storage was last tried) is a column of the
connections table here, so a restarted pass knows it.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.functions.timebins import age_seconds
from runledger.operators.merge import EVENT_KEY, backfill_fingerprints
from runledger.operators.reads import first_per_connection
from runledger.operators.shapes import fingerprinted, fingerprinted_by_text
from runledger.sources.history import history_page, is_readable, readable_rows, storage_scan, to_events
from runledger.sources.tables import LAYOUT, Tables


@dataclass(frozen=True)
class IngestSettings:
    """Defaults of the reference deployment."""

    overlap: timedelta = timedelta(minutes=15)
    batch_limit: int = 5000
    # Batches that are kept as deltas before they are merged into their slots.
    compact_after: int = 16
    backfill_limit: int | None = None
    storage_interval: timedelta = timedelta(hours=1)
    poll_interval: timedelta = timedelta(seconds=60)


def _micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def earlier(ts: Column, span: timedelta) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) - F.lit(_micros(span)))


def fetch_plan(connections: DataFrame, overlap: timedelta) -> DataFrame:
    """From when each enabled connection is read.

    The overlap re-reads the head for rows published late. A connection whose last page was full starts at its watermark
    instead: the rows still owed lie ahead, and the overlap would crowd them out.
    """
    mark = F.col("watermark_start_time")
    since = F.when(F.col("catching_up"), mark).otherwise(earlier(mark, overlap))
    return connections.where("enabled").select(
        F.col("id").alias("connection_id"),
        mark.alias("watermark_start_time"),
        "catching_up",
        since.alias("since"),
    )


def newest_starts(drafts: DataFrame) -> DataFrame:
    return drafts.groupBy("connection_id").agg(F.max("start_time").alias("newest"))


def advance_watermark(connections: DataFrame, newest: DataFrame) -> DataFrame:
    """The watermark is the newest start seen. It never moves back and survives an empty batch."""
    return connections.join(newest.withColumnRenamed("connection_id", "id"), "id", "left").select(
        F.col("id").alias("connection_id"),
        F.greatest("watermark_start_time", "newest").alias("watermark_start_time"),
    )


def batch_stats(page: DataFrame) -> DataFrame:
    """Per connection: rows returned, rows lost, newest readable start."""
    newest = F.max(F.when(is_readable(), F.timestamp_millis("start_ms"))).alias("newest")
    return page.groupBy("connection_id").agg(
        F.count(F.lit(1)).alias("rows_returned"), F.count_if(~is_readable()).alias("unreadable"), newest
    )


def sync_outcome(plan: DataFrame, stats: DataFrame, limit: int, fetch_errors: DataFrame | None = None) -> DataFrame:
    """How the pass went per connection.

    A full page that leaves a catching-up connection's watermark where it was can never be stepped past; that is an
    error with one of two causes. Lost rows are a warning. A failed fetch (connection_id, fetch_error) concerns its own
    connection only and leaves its position untouched.
    """
    if fetch_errors is None:
        joined = plan.join(stats, "connection_id", "left").withColumn("fetch_error", F.lit(None).cast("string"))
    else:
        joined = plan.join(stats, "connection_id", "left").join(
            fetch_errors.select("connection_id", "fetch_error"), "connection_id", "left"
        )
    returned = F.coalesce("rows_returned", F.lit(0))
    lost = F.coalesce("unreadable", F.lit(0))
    failed = F.col("fetch_error").isNotNull()
    filled = returned >= limit
    mark = F.col("watermark_start_time")
    advanced = F.greatest(mark, F.col("newest"))
    stalled = F.col("catching_up") & filled & advanced.eqNullSafe(mark)
    error = (
        F.when(failed, F.col("fetch_error"))
        .when(stalled & (lost > 0), F.concat(lost.cast("string"), F.lit(" unreadable rows block the way past the watermark")))
        .when(stalled, F.lit(f"over {limit} runs start at one instant; raise the batch limit"))
    )
    broken = failed | stalled
    warning = F.when(~broken & (lost > 0), F.concat(lost.cast("string"), F.lit(" unreadable rows were skipped")))
    return joined.select(
        "connection_id",
        F.when(broken, mark).otherwise(advanced).alias("watermark_start_time"),
        F.when(failed, F.col("catching_up")).otherwise(filled).alias("catching_up"),
        returned.alias("rows_returned"),
        lost.alias("unreadable"),
        (~broken).alias("succeeded"),
        error.alias("sync_error"),
        warning.alias("ingest_warning"),
    )


def apply_sync_state(connections: DataFrame, outcome: DataFrame, now: Column) -> DataFrame:
    """Records a pass. Watermark, attempt and error are replaced; success and warning keep their old value when the pass
    has none, because rows once lost stay lost. Connections not in the pass are unchanged."""
    passed = outcome.select(
        F.col("connection_id").alias("id"),
        F.lit(True).alias("_passed"),
        F.col("watermark_start_time").alias("_mark"),
        F.col("catching_up").alias("_catching_up"),
        F.when(F.col("succeeded"), now).alias("_success"),
        F.col("sync_error").alias("_error"),
        F.col("ingest_warning").alias("_warning"),
    )
    took_part = F.col("_passed").isNotNull()
    changed = {
        "watermark_start_time": F.when(took_part, F.col("_mark")).otherwise(F.col("watermark_start_time")),
        "last_synced_at": F.when(took_part, now).otherwise(F.col("last_synced_at")),
        "last_success_at": F.coalesce("_success", "last_success_at"),
        "last_sync_error": F.when(took_part, F.col("_error")).otherwise(F.col("last_sync_error")),
        "last_ingest_warning": F.coalesce("_warning", "last_ingest_warning"),
        "updated_at": F.when(took_part, now).otherwise(F.col("updated_at")),
        "catching_up": F.when(took_part, F.col("_catching_up")).otherwise(F.col("catching_up")),
    }
    joined = connections.join(passed, "id", "left")
    return joined.select(*[changed.get(name, F.col(name)).alias(name) for name in connections.columns])


def storage_due(connections: DataFrame, now: Column, interval: timedelta) -> DataFrame:
    """Enabled connections whose storage is to be read: never tried, or tried at least an interval ago."""
    age = age_seconds(now, F.col("storage_attempted_at"))
    due = F.col("storage_attempted_at").isNull() | (age >= int(interval.total_seconds()))
    return connections.where(F.col("enabled") & due).select(F.col("id").alias("connection_id"))


def mark_storage_attempt(connections: DataFrame, due: DataFrame, now: Column) -> DataFrame:
    """Recorded whether or not the read works, so a connection without the permission is not asked every pass."""
    tried = due.select(F.col("connection_id").alias("id"), F.lit(True).alias("_due"))
    return (
        connections.join(tried, "id", "left")
        .withColumn("storage_attempted_at", F.when(F.col("_due"), now).otherwise(F.col("storage_attempted_at")))
        .select(*connections.columns)
    )


def staged(rows: DataFrame, path: str, spark: SparkSession | None = None) -> DataFrame:
    """The rows, read back from a shared folder: computed once for everything that follows, and safe from lost executors.
    The folder is overwritten by the next batch. ``spark`` is the session that reads them, if another than that of the rows."""
    rows.write.mode("overwrite").parquet(path)
    return (spark or rows.sparkSession).read.schema(rows.schema).parquet(path)


def store_batch(tables: Tables, drafts: DataFrame, staging: str, now: Column, writer: str, batch: int) -> None:
    """Shapes first, then events, so a stored fingerprint always has its shape. Safe to repeat with the same rows, as the
    same batch of the same writer."""
    events = staged(fingerprinted_by_text(to_events(drafts, now), f"{staging}/texts"), f"{staging}/events")
    tables.register_shapes(events)
    tables.append_events(events, writer, batch)


def backfill(tables: Tables, staging: str, limit: int | None = None) -> None:
    """Stamps the stored events that have no fingerprint, all or the newest of each connection, and registers their shapes.
    They are found and stamped once and staged; only the slots that hold them are rewritten."""
    stored = tables.events()
    waiting = stored.where(F.col("fingerprint").isNull())
    if limit is not None:
        keys = [*EVENT_KEY, *LAYOUT]
        first = first_per_connection(waiting.select(*keys, "start_time"), [F.desc("start_time"), F.asc("query_id")], limit)
        waiting = waiting.join(first.select(*keys), keys, "left_semi")
    if not waiting.limit(1).count():
        return
    stamped = staged(fingerprinted(waiting), f"{staging}/stamped")
    tables.register_shapes(stamped)
    tables.replace_slots(backfill_fingerprints(tables.slots_of(stamped), stamped))


def ingest_pass(
    tables: Tables,
    history: DataFrame,
    pass_number: int,
    staging: str,
    now: Column,
    settings: IngestSettings = IngestSettings(),
    storage: DataFrame | None = None,
    fetch_errors: DataFrame | None = None,
) -> None:
    """Fetches, stores and accounts for one page per enabled connection, then stamps what has no fingerprint or flags yet
    and, given raw ``storage`` measurements, stores those of the connections that are due.

    A connection in ``fetch_errors`` (connection_id, fetch_error) failed to be read: the others go on.

    The page is staged because it feeds the counts as well as the tables, and a live source may answer differently the
    second time. The accounts are written last: a pass that fails half way is read again from the old watermark, which
    the keyed merges make harmless.
    """
    connections = tables.connections()
    plan = fetch_plan(connections, settings.overlap)
    fetched = plan if fetch_errors is None else plan.join(fetch_errors, "connection_id", "left_anti")
    page = staged(history_page(history, fetched, settings.batch_limit), f"{staging}/page")
    store_batch(tables, readable_rows(page), staging, now, "pass", pass_number)
    tables.compact(settings.compact_after)
    backfill(tables, staging, settings.backfill_limit)
    tables.backfill_flags()
    outcome = sync_outcome(plan, batch_stats(page), settings.batch_limit, fetch_errors)
    after = apply_sync_state(connections, outcome, now)
    if storage is not None:
        due = storage_due(connections, now, settings.storage_interval)
        tables.append_storage(storage_scan(storage.join(due, "connection_id", "left_semi"), now))
        after = mark_storage_attempt(after, due, now)
    tables.record_connections(after, pass_number)
