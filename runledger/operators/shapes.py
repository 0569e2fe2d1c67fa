"""Ranked query shapes and the shape table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions import pricing
from runledger.functions.statements import (
    cut,
    fingerprint_of,
    flags,
    is_cut,
    is_select,
    labelled,
    shape_key,
    with_normalized,
)
from runledger.operators.reads import first_per_connection, select_events, tiers, with_share
from runledger.plans.params import DEFAULT_LIST_LIMIT, EventFilter
from runledger.schema import KNOWN_FLAGS

SHAPE_KEY = ["connection_id", "fingerprint"]


def fingerprinted(events: DataFrame) -> DataFrame:
    """Stamps rows that have no fingerprint yet and leaves the others' text alone. Map-only: text is normalized where it is
    read and never shuffled."""
    fresh = F.col("query_text")
    stamped = fingerprint_of(shape_key(F.col("_normal")))
    if "fingerprint" in events.columns:
        fresh = F.when(F.col("fingerprint").isNull(), fresh)
        stamped = F.coalesce("fingerprint", stamped)
    normal = with_normalized(events.withColumn("_text", fresh), "_text", "_normal")
    return normal.withColumn("fingerprint", stamped).drop("_text", "_normal")


def fingerprinted_by_text(events: DataFrame, path: str) -> DataFrame:
    """The same, with each distinct text normalized once however many rows repeat it. The fingerprints of the texts are
    written to ``path``, so that their size decides whether the rows meet them without a shuffle."""
    waiting = events.where(F.col("fingerprint").isNull()) if "fingerprint" in events.columns else events
    texts = waiting.select("query_text").distinct()
    stamped = fingerprinted(texts).select("query_text", F.col("fingerprint").alias("_stamped"))
    stamped.write.mode("overwrite").parquet(path)
    known = events.sparkSession.read.schema(stamped.schema).parquet(path)
    joined = events.join(known.withColumnRenamed("query_text", "_text"), F.col("query_text") == F.col("_text"), "left")
    found = F.coalesce("fingerprint", "_stamped") if "fingerprint" in events.columns else F.col("_stamped")
    return joined.withColumn("fingerprint", found).drop("_text", "_stamped")


def shape_sums() -> dict[str, Column]:
    """What a shape is judged by besides counts and cost. All but the two maxima add up."""
    return {
        "max_ms": F.coalesce(F.greatest(F.max("total_elapsed_time_ms"), F.lit(0)), F.lit(0)),
        "bytes_spilled": F.coalesce(F.sum("bytes_spilled_to_disk"), F.lit(0)),
        "last_seen": F.max("start_time"),
    }


def shape_figures(events: DataFrame, connections: DataFrame, flt: EventFilter) -> DataFrame:
    """One priced row per shape with its share, text left aside: only narrow columns are shuffled.

    Rows without a fingerprint are not part of any shape, so the share's base can be below the summary's cost.
    """
    groups = (
        select_events(events, flt)
        .where(F.col("fingerprint").isNotNull())
        .groupBy(*SHAPE_KEY)
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.count("error_type").alias("failure_count"),
            pricing.runtime_sums()["total_ms"].alias("total_ms"),
            *[total.alias(name) for name, total in {**shape_sums(), **pricing.billable_sums()}.items()],
        )
    )
    return priced_shapes(groups, connections, flt)


def priced_shapes(groups: DataFrame, connections: DataFrame, flt: EventFilter) -> DataFrame:
    priced = groups.join(tiers(connections, flt), "connection_id").select(
        *SHAPE_KEY,
        "runs",
        "failure_count",
        "total_ms",
        "max_ms",
        "bytes_spilled",
        "last_seen",
        pricing.billable_cost().alias("estimated_cost_usd"),
    )
    return with_share(priced, flt)


def known_flags(stored: Column) -> Column:
    """Names this release does not know are ignored; not examined reads as clean."""
    names = F.array(*[F.lit(name) for name in KNOWN_FLAGS])
    known = F.filter(stored, lambda name: F.array_contains(names, name))
    return F.coalesce(known, F.array().cast("array<string>"))


def with_flags(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """Adds the stored flags. Only the key and the flags of the shape table take part."""
    stored = shapes.select(*SHAPE_KEY, "antipatterns")
    return rows.join(stored, SHAPE_KEY, "left").withColumn("antipatterns", known_flags(F.col("antipatterns")))


# A list up to this long may be sent to every task.
SHORT_LIST = 10_000


def with_examples(rows: DataFrame, shapes: DataFrame, few: bool, preview: int | None = None) -> DataFrame:
    """Adds the example statement in list form.

    ``few`` states that ``rows`` is one connection's list of at most ``SHORT_LIST`` rows. The list is then sent to the shape table instead of
    the table's long text to the list.
    """
    texts = shapes.select(*SHAPE_KEY, "example_sql")
    if few:
        texts = texts.join(F.broadcast(rows.select(*SHAPE_KEY).distinct()), SHAPE_KEY, "left_semi")
    full = F.coalesce("example_sql", F.lit(""))
    return (
        rows.join(texts, SHAPE_KEY, "left")
        .withColumn("is_cut", is_cut(full, preview))
        .withColumn("example_sql", cut(full, preview))
    )


def shape_order() -> list[Column]:
    return [F.desc("estimated_cost_usd"), F.desc("runs"), F.asc("fingerprint")]


def top_shapes(
    events: DataFrame,
    shapes: DataFrame,
    connections: DataFrame,
    flt: EventFilter,
    limit: int | None = DEFAULT_LIST_LIMIT,
    preview: int | None = None,
) -> DataFrame:
    """The dearest shapes. Shares are of everything, not of what the list shows."""
    return listed_shapes(shape_figures(events, connections, flt), shapes, flt, limit, preview)


def listed_shapes(
    figures: DataFrame, shapes: DataFrame, flt: EventFilter, limit: int | None = DEFAULT_LIST_LIMIT, preview: int | None = None
) -> DataFrame:
    few = flt.connection_id is not None and limit is not None
    if few:
        top = figures.orderBy(*shape_order()).limit(limit)
    else:
        top = first_per_connection(figures, shape_order(), limit)
    return (
        with_examples(with_flags(top, shapes), shapes, few and limit <= SHORT_LIST, preview)
        .withColumn("copy_sql", labelled(F.col("example_sql"), F.col("is_cut"), preview))
        .orderBy("connection_id", *shape_order())
    )


def shape_statements(shapes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Full example statements for the (connection_id, fingerprint) pairs of ``wanted``."""
    return shapes.join(wanted.select(*SHAPE_KEY).distinct(), SHAPE_KEY).select(
        *SHAPE_KEY, "example_sql", "parsed", "first_seen"
    )


def new_shapes(events: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """A row for every shape of ``events`` that ``existing`` lacks, from its earliest event; of a run that was read more
    than once with several texts, the smallest.

    The events are read, and their texts normalized, once. Map tasks keep one row a shape before the shuffle, so a shape
    that makes up most of the history sends one row per task.
    """
    rows = fingerprinted(events).select(*SHAPE_KEY, "start_time", "query_id", "query_text")
    earliest = Window.partitionBy(*SHAPE_KEY).orderBy("start_time", "query_id", "query_text")
    first = rows.withColumn("_place", F.row_number().over(earliest)).where("_place = 1")
    if existing is not None:
        first = first.join(existing.select(*SHAPE_KEY), SHAPE_KEY, "left_anti")
    examples = first.select(*SHAPE_KEY, F.col("start_time").alias("first_seen"), F.col("query_text").alias("example_sql"))
    return with_normalized(examples, "example_sql").select(
        *SHAPE_KEY,
        "normalized_sql",
        "example_sql",
        is_select(F.col("normalized_sql")).alias("parsed"),
        flags(F.col("normalized_sql")).alias("antipatterns"),
        "first_seen",
    )


def register_shapes(existing: DataFrame, events: DataFrame) -> DataFrame:
    """Insert if absent: a shape keeps the example and first-seen time it was stored with."""
    return existing.unionByName(new_shapes(events, existing))


def pending_flags(shapes: DataFrame, limit: int | None = None) -> DataFrame:
    """Shapes not examined yet: all, or the oldest of each connection."""
    waiting = shapes.where(F.col("antipatterns").isNull()).select(*SHAPE_KEY, "example_sql", "first_seen")
    return first_per_connection(waiting, [F.asc("first_seen"), F.asc("fingerprint")], limit)


def backfill_flags(shapes: DataFrame, pending: DataFrame) -> DataFrame:
    """Stores the flags of ``pending``. A clean statement stores an empty array, so it is not examined again."""
    normalized = with_normalized(pending.select(*SHAPE_KEY, "example_sql"), "example_sql")
    examined = normalized.select(*SHAPE_KEY, flags(F.col("normalized_sql")).alias("_found"))
    return (
        shapes.join(examined, SHAPE_KEY, "left")
        .withColumn("antipatterns", F.coalesce("_found", "antipatterns"))
        .select(*shapes.columns)
    )
