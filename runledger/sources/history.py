"""The query-history source: paging, unreadable rows and the step from a fetched row to an event."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runledger.functions.timebins import interval_ms
from runledger.operators.merge import SEQ
from runledger.operators.reads import first_per_connection
from runledger.schema import EVENTS, HISTORY, SELF_AGENT_TAG, SELF_SQL_MARKER, STORAGE_BYTES

# Ids may be hyphenated or plain hex, in braces or with the urn prefix; times span the years the source's
# calendar can express, in epoch milliseconds.
_HEX = "[0-9a-fA-F]"
_HYPHENATED = f"{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}"
UUID_PATTERN = rf"^(?:{_HEX}{{32}}|(?:urn:uuid:)?{_HYPHENATED}|\{{{_HYPHENATED}\}})$"
MIN_MS, MAX_MS = -8_334_601_228_800_000, 8_210_266_876_799_999


# History columns that a draft holds in another form.
_RESHAPED = ("query_id", "query_text", "query_type", "start_ms", "end_ms")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """History exported as parquet, with a delivery number. Any Spark reader that yields the ``HISTORY`` columns serves as
    well."""
    return numbered(spark.read.schema(HISTORY).parquet(path))


def stream_history(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The same as a stream of the files that arrive in a folder."""
    reader = spark.readStream.schema(HISTORY)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return numbered(reader.parquet(path))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of a file source with their delivery number ``seq``: by when the file was written, then by its name, then by
    place in it. No two rows share one, and repeats of a row keep theirs."""
    written = F.lpad(F.unix_millis("_metadata.file_modification_time").cast("string"), 16, "0")
    place = F.lpad(F.col("_metadata.row_index").cast("string"), 16, "0")
    return rows.select("*", F.concat_ws("/", written, F.col("_metadata.file_path"), place).alias(SEQ))


def with_epoch_ms(rows: DataFrame, times: dict[str, str], intervals: dict[str, str]) -> DataFrame:
    """Turns timestamp and interval columns into millisecond columns; both arguments map source to target names."""
    converted = {name: F.unix_millis(name).alias(target) for name, target in times.items()}
    converted |= {name: interval_ms(F.col(name)).alias(target) for name, target in intervals.items()}
    return rows.select(*[converted.get(name, F.col(name)) for name in rows.columns])


def history_page(history: DataFrame, plan: DataFrame, limit: int) -> DataFrame:
    """The oldest ``limit`` rows per connection from its ``since`` on, which is inclusive because rows can share an
    instant. ``plan`` has ``connection_id``, a nullable ``since`` and maybe a nullable ``after``, the last row that an
    earlier page gave.

    Only ids and times are ranked, to find the last row of each page; whole rows are then taken up to it. Rows that
    repeat it come along, so a page of such rows can be longer.
    """
    bounds = plan.select("connection_id", "since", *[name for name in plan.columns if name == "after"])
    narrow = _due(history.select("connection_id", "start_ms", "query_id"), bounds)
    last = _page_ends(narrow, limit) if limit > SHORT_PAGE else _short_page_ends(narrow, limit)
    due = _due(history, bounds.join(last, "connection_id"))
    return due.where(_place() <= F.col("_last")).drop(*bounds.columns[1:], "_last")


# A page up to this long is ranked as a whole, which map tasks prune; ``SALTS`` times as many rows meet in a task at most.
SHORT_PAGE = 5_000
# Parts that the rows of each connection are dealt to, to meet the bounds of their connection.
PARTS = 32
_MINUTE_MS = 60_000


def _due(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """The rows on and after their connection's bounds, with these. A connection that owns most of the rows meets copies of
    its bounds in ``PARTS`` places."""
    copies = bounds.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("query_id", "start_ms"), F.lit(PARTS)).cast("int"))
    due = dealt.join(copies, ["connection_id", "_part"]).drop("_part")
    due = due.where(F.col("since").isNull() | (F.col("start_ms") >= F.unix_millis("since")))
    return due.where(F.col("after").isNull() | (_place() > F.col("after"))) if "after" in bounds.columns else due


def _short_page_ends(due: DataFrame, limit: int) -> DataFrame:
    page = first_per_connection(due.select("connection_id", "start_ms", "query_id"), [F.asc("start_ms"), F.asc("query_id")], limit)
    return page.groupBy("connection_id").agg(F.max(_place()).alias("_last"))


def _page_ends(due: DataFrame, limit: int) -> DataFrame:
    """The place of the last of the first ``limit`` rows of each connection, as ``_last``.

    Rows are counted by minute, and only those of the minute in which a page ends are ranked, so that no task holds the
    page of a connection, however long it may be.
    """
    timed = due.select("connection_id", "start_ms", "query_id", F.floor(F.col("start_ms") / _MINUTE_MS).alias("_minute"))
    counted = timed.groupBy("connection_id", "_minute").agg(F.count("*").alias("_rows"), F.max(_place()).alias("_last"))
    upto = Window.partitionBy("connection_id").orderBy("_minute").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = counted.withColumn("_left", F.lit(limit) - (F.sum("_rows").over(upto) - F.col("_rows"))).where("_left > 0")
    split = begun.where("_rows > _left").select(F.col("connection_id").alias("_owner"), F.col("_minute").alias("_at"), "_left")
    ranked = timed.join(split, F.expr("connection_id = _owner and _minute <=> _at"))
    ranked = ranked.withColumn("_part", F.pmod(F.xxhash64("query_id", "start_ms"), F.lit(PARTS)))
    for keys in (["connection_id", "_part"], ["connection_id"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("start_ms", "query_id"))
        ranked = ranked.withColumn("_rank", rank).where("_rank <= _left")
    whole = begun.where("_rows <= _left").select("connection_id", "_last")
    ends = whole.unionByName(ranked.select("connection_id", _place().alias("_last")))
    return ends.groupBy("connection_id").agg(F.max("_last").alias("_last"))


def _place() -> Column:
    """Where a row stands in its connection's history; nulls come first."""
    return F.struct("start_ms", "query_id")


def drained(history: DataFrame, plan: DataFrame, limit: int, store: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """All pages of at most ``limit`` rows a connection, one after the other, until no connection has a full one. ``store``
    writes a page and returns it as written. Pages go on after the last row of the one before, so rows that share an instant
    are neither repeated nor lost, however many they are."""
    plan = plan.select("connection_id", "since").withColumn("after", F.lit(None).cast("struct<start_ms: bigint, query_id: string>"))
    pages = []
    while True:
        pages.append(store(history_page(history, plan, limit)))
        ends = pages[-1].groupBy("connection_id").agg(F.max(_place()).alias("after"), F.count("*").alias("rows"))
        ends = ends.where(F.col("rows") >= limit).drop("rows")
        if not ends.limit(1).count():
            return pages
        plan = plan.drop("after").join(ends, "connection_id")


def _in_calendar(ms: Column) -> Column:
    return ms.between(MIN_MS, MAX_MS)


def is_readable() -> Column:
    readable = F.col("query_id").rlike(UUID_PATTERN) & _in_calendar(F.col("start_ms"))
    return F.coalesce(readable, F.lit(False))


def canonical_id(raw: Column) -> Column:
    """Lower case with hyphens, whichever accepted form it came in."""
    digits = F.regexp_replace(F.lower(raw), "urn:uuid:|[^0-9a-f]", "")
    return F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _event_time(ms: Column) -> Column:
    return F.when(_in_calendar(ms), F.timestamp_millis(ms))


def readable_rows(page: DataFrame) -> DataFrame:
    """Rows with a usable id and start time, as drafts. A bad row costs itself, never the batch."""
    return page.where(is_readable()).select(
        "connection_id",
        canonical_id(F.col("query_id")).alias("query_id"),
        F.coalesce("query_text", F.lit("")).alias("query_text"),
        "query_type",
        _event_time(F.col("start_ms")).alias("start_time"),
        _event_time(F.col("end_ms")).alias("end_time"),
        *[name for name in page.columns if name not in ("connection_id", *_RESHAPED)],
    )


def unreadable_rows(page: DataFrame) -> DataFrame:
    """The quarantine: everything :func:`readable_rows` leaves out."""
    return page.where(~is_readable())


def page_counts(page: DataFrame) -> DataFrame:
    """Rows returned and rows lost per connection. Whether a page is full is judged on the former."""
    return page.groupBy("connection_id").agg(
        F.count(F.lit(1)).alias("rows_returned"), F.count_if(~is_readable()).alias("unreadable")
    )


def internal_traffic() -> Column:
    """This engine's own statements, by agent tag or by marker comment. A missing agent is not a match."""
    tagged = F.contains(F.lower("user_agent"), F.lit(SELF_AGENT_TAG))
    return F.coalesce(tagged, F.lit(False)) | F.contains("query_text", F.lit(SELF_SQL_MARKER))


def to_events(drafts: DataFrame, ingested_at: Column) -> DataFrame:
    """Drafts as events: flagged as own traffic or not, stamped with the ingest time, not fingerprinted yet. A delivery
    number (``seq``) stays."""
    return (
        drafts.withColumn("is_internal", internal_traffic())
        .withColumn("fingerprint", F.lit(None).cast("string"))
        .withColumn("ingested_at", ingested_at)
        .select(*EVENTS.names, *[name for name in drafts.columns if name == SEQ])
    )


def storage_scan(raw: DataFrame, ingested_at: Column) -> DataFrame:
    """Measurements of live databases; deleted ones cost nothing. A missing byte count is zero."""
    counts = [F.coalesce(name, F.lit(0)).alias(name) for name in STORAGE_BYTES]
    return raw.where(F.col("deleted_ts").isNull()).select(
        "connection_id",
        F.coalesce("database_name", F.lit("")).alias("database_name"),
        "computed_at",
        *counts,
        ingested_at.alias("ingested_at"),
    )
