"""Aggregate and list reads over events. Every read covers all connections unless its filter names one.

``connections`` supplies the price tier and decides which connections get a row. All joins to it are on its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions import pricing
from runledger.functions.statements import cut, is_cut
from runledger.functions.timebins import bin_start, bucket_grid
from runledger.operators.quantiles import summarize, used_whole
from runledger.plans.params import SORT_COLUMNS, EventFilter, ListOptions

ATTRIBUTION_KEYS = ("user_name", "instance_type")
CHANGE_FLOOR_USD = 0.01
PERCENTILES = {"p50_ms": 0.5, "p95_ms": 0.95}


def counts() -> dict[str, Column]:
    return {"query_count": F.count(F.lit(1)), "failure_count": F.count("error_type")}


def _aliased(columns: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]


def select_events(events: DataFrame, flt: EventFilter) -> DataFrame:
    return events.where(flt.predicate(events.columns))


def tiers(connections: DataFrame, flt: EventFilter | None = None) -> DataFrame:
    """Connection ids with the rates of their tier. Of one connection that is one row, so it is broadcast; of all of them
    it is left to statistics, and beyond the broadcast threshold to a join that AQE splits where one id dominates."""
    one = flt is not None and flt.connection_id is not None
    wanted = connections.where(F.col("id") == flt.connection_id) if one else connections
    known = wanted.select(F.col("id").alias("connection_id"), pricing.stored_tier("region_tier").alias("tier"))
    rated = known.select("connection_id", *pricing.rates("tier"))
    return F.broadcast(rated) if one else rated


def _one_connection(flt: EventFilter) -> bool:
    return flt.connection_id is not None


def summary(events: DataFrame, connections: DataFrame, flt: EventFilter) -> DataFrame:
    """Headline figures. A connection without events gets zeros and null percentiles."""
    figures = summarize(
        select_events(events, flt),
        ["connection_id"],
        "total_elapsed_time_ms",
        PERCENTILES,
        {**counts(), **pricing.billable_sums()},
        few_groups=_one_connection(flt),
    )
    return headline(figures, connections, flt)


def headline(figures: DataFrame, connections: DataFrame, flt: EventFilter) -> DataFrame:
    return tiers(connections, flt).join(figures, "connection_id", "left").select(
        "connection_id",
        F.coalesce("query_count", F.lit(0)).alias("query_count"),
        F.coalesce("failure_count", F.lit(0)).alias("failure_count"),
        *PERCENTILES,
        pricing.billable_cost().alias("estimated_cost_usd"),
    )


def summary_by_instance_type(events: DataFrame, connections: DataFrame, flt: EventFilter) -> DataFrame:
    """Per size as stored: spelling variants stay apart but price alike. Most queries first."""
    size = F.coalesce("instance_type", F.lit(pricing.UNKNOWN)).alias("instance_type")
    groups = (
        select_events(events, flt)
        .groupBy("connection_id", size)
        .agg(F.count(F.lit(1)).alias("query_count"), *_aliased(pricing.runtime_sums()))
    )
    return groups.join(tiers(connections, flt), "connection_id").select(
        "connection_id",
        "instance_type",
        "query_count",
        "total_ms",
        "sub_second_count",
        "sub_second_ms",
        pricing.group_cost("instance_type").alias("estimated_cost_usd"),
    ).orderBy("connection_id", F.desc("query_count"), "instance_type")


def latency_buckets(events: DataFrame, connections: DataFrame, flt: EventFilter, ordered: bool = True) -> DataFrame:
    """Counts, percentiles and cost per time bucket, empty buckets included. What aggregates them needs no order.

    The reference semantics are a range join from the grid; since an event in the range falls in exactly one bucket,
    grouping by the computed bucket and joining on equality gives the same rows without one.
    """
    rows = select_events(events, flt).withColumn("bucket_start", bin_start(F.col("start_time"), flt.range))
    figures = summarize(
        rows,
        ["connection_id", "bucket_start"],
        "total_elapsed_time_ms",
        PERCENTILES,
        {**counts(), **pricing.billable_sums()},
        few_groups=_one_connection(flt),
    )
    buckets = (
        bucket_grid(tiers(connections, flt), flt.range)
        .join(figures, ["connection_id", "bucket_start"], "left")
        .select(
            "connection_id",
            "bucket_start",
            F.coalesce("query_count", F.lit(0)).alias("query_count"),
            F.coalesce("failure_count", F.lit(0)).alias("failure_count"),
            *PERCENTILES,
            pricing.billable_cost().alias("estimated_cost_usd"),
        )
    )
    return buckets.orderBy("connection_id", "bucket_start") if ordered else buckets


def cost_buckets(events: DataFrame, connections: DataFrame, flt: EventFilter, ordered: bool = True) -> DataFrame:
    """Cost per time bucket over the full grid; an empty bucket costs nothing."""
    groups = (
        select_events(events, flt)
        .groupBy("connection_id", bin_start(F.col("start_time"), flt.range).alias("bucket_start"))
        .agg(F.count(F.lit(1)).alias("query_count"), *_aliased(pricing.billable_sums()))
    )
    buckets = (
        bucket_grid(tiers(connections, flt), flt.range)
        .join(groups, ["connection_id", "bucket_start"], "left")
        .select(
            "connection_id",
            "bucket_start",
            F.coalesce("query_count", F.lit(0)).alias("query_count"),
            pricing.billable_cost().alias("estimated_cost_usd"),
        )
    )
    return buckets.orderBy("connection_id", "bucket_start") if ordered else buckets


def _spenders(events: DataFrame, connections: DataFrame, flt: EventFilter, key: str) -> DataFrame:
    """One row per key seen in the period or the one before, both priced. One scan and one shuffle serve both."""
    if key not in ATTRIBUTION_KEYS:
        raise ValueError("key must be user_name or instance_type")
    now = flt.range.covers("start_time")
    groups = (
        select_events(events, flt.over(flt.range.with_previous()))
        .groupBy("connection_id", F.coalesce(key, F.lit(pricing.UNKNOWN)).alias("key"))
        .agg(
            F.expr(f"count_if({now})").alias("query_count"),
            F.expr(f"count_if({now} and error_type is not null)").alias("failure_count"),
            F.expr(f"sum(case when {now} then {pricing.SPENT_MS} else 0 end)").alias("total_ms"),
            *_aliased(pricing.billable_sums(now, "current")),
            *_aliased(pricing.billable_sums(f"not ({now})", "previous")),
        )
    )
    return priced_spenders(groups, connections, flt)


def priced_spenders(groups: DataFrame, connections: DataFrame, flt: EventFilter) -> DataFrame:
    return groups.join(tiers(connections, flt), "connection_id").select(
        "connection_id",
        "key",
        "query_count",
        "failure_count",
        "total_ms",
        pricing.billable_cost("current").alias("estimated_cost_usd"),
        pricing.billable_cost("previous").alias("previous_cost_usd"),
    )


def with_share(rows: DataFrame, flt: EventFilter) -> DataFrame:
    """Adds ``cost_share`` of the connection's total, 0 when there is none.

    The total comes from a partial aggregate and an equality join, so no connection's rows need to meet in one task. Of
    one connection it is one row and broadcast.
    """
    # Both uses of ``rows`` keep all columns, whatever the caller drops, and share one shuffle.
    whole = rows.where(used_whole(rows))
    total = whole.groupBy(F.col("connection_id").alias("_owner")).agg(F.sum("estimated_cost_usd").alias("_total"))
    share = F.expr("case when _total > 0 then estimated_cost_usd / _total else 0D end")
    joined = whole.join(F.broadcast(total) if _one_connection(flt) else total, F.expr("connection_id <=> _owner"))
    return joined.withColumn("cost_share", share).drop("_total", "_owner")


def attribution(events: DataFrame, connections: DataFrame, flt: EventFilter, key: str) -> DataFrame:
    """Spenders of the period with their share, what they cost before and the change, biggest first."""
    return ranked_spenders(_spenders(events, connections, flt, key), flt)


def ranked_spenders(spenders: DataFrame, flt: EventFilter) -> DataFrame:
    active = spenders.where(F.col("query_count") > 0)
    previous = F.col("previous_cost_usd")
    change = (F.col("estimated_cost_usd") - previous) / previous * 100
    return (
        with_share(active, flt)
        .withColumn("change_pct", F.when(previous >= CHANGE_FLOOR_USD, change))
        .select(
            "connection_id",
            "key",
            "query_count",
            "failure_count",
            "total_ms",
            "estimated_cost_usd",
            "cost_share",
            "previous_cost_usd",
            "change_pct",
        )
        .orderBy("connection_id", F.desc("estimated_cost_usd"), "key")
    )


def attribution_totals(events: DataFrame, connections: DataFrame, flt: EventFilter) -> DataFrame:
    """Period totals. The previous one covers everybody active then, including those who have stopped since."""
    totals = (
        _spenders(events, connections, flt, "user_name")
        .groupBy("connection_id")
        .agg(*[F.sum(name).alias(name) for name in ("estimated_cost_usd", "previous_cost_usd", "total_ms")])
    )
    return tiers(connections, flt).join(totals, "connection_id", "left").select(
        "connection_id",
        F.coalesce("estimated_cost_usd", F.lit(0.0)).alias("estimated_cost_usd"),
        F.coalesce("previous_cost_usd", F.lit(0.0)).alias("previous_cost_usd"),
        F.coalesce("total_ms", F.lit(0)).alias("total_ms"),
    )


def with_run_cost(events: DataFrame, connections: DataFrame) -> DataFrame:
    """Adds what each run cost, null where it cannot be priced."""
    priced = events.join(tiers(connections), "connection_id").withColumn("estimated_cost_usd", pricing.run_cost())
    return priced.drop(*pricing.RATE_COLUMNS)


# Groups a connection's rows are ranked in before they are ranked together.
SALTS = 64


def first_per_connection(rows: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """The first rows of each connection; without a limit, all.

    Ranked twice: within ``SALTS`` groups of a connection, then among the firsts of these, so that a connection that owns
    most of the data is spread over many tasks and the last one sees ``SALTS * limit`` of its rows at most.
    """
    if limit is None:
        return rows
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    for keys in (["connection_id", "_salt"], ["connection_id"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        salted = salted.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")
    return salted.drop("_salt")


def list_events(events: DataFrame, connections: DataFrame, flt: EventFilter, options: ListOptions) -> DataFrame:
    """The slow list or the failure list, priced, with long statements cut."""
    kept = F.col("error_type").isNotNull() if options.failures_only else F.col("total_elapsed_time_ms").isNotNull()
    rows = select_events(events, flt).where(kept)
    # Ranked without the statement texts, which are fetched for the rows that stay, from their slots only.
    place = [name for name in ("start_date", "start_slot") if name in rows.columns]
    keys = ["connection_id", "query_id", *place]
    narrow = rows.select(*keys, *sorted({SORT_COLUMNS[options.sort]} - set(keys)))
    if options.limit is None:
        top = rows
    elif flt.connection_id is None:
        top = rows.join(first_per_connection(narrow, options.order(), options.limit).select(*keys), keys, "left_semi")
    else:
        top = rows.join(narrow.orderBy(*options.order()).limit(options.limit).select(*keys), keys, "left_semi")
    return (
        with_run_cost(top, connections)
        .withColumn("is_cut", is_cut(F.col("query_text"), options.preview))
        .withColumn("query_text", cut(F.col("query_text"), options.preview))
        .orderBy("connection_id", *options.order())
    )


def slow_queries(
    events: DataFrame, connections: DataFrame, flt: EventFilter, options: ListOptions = ListOptions()
) -> DataFrame:
    return list_events(events, connections, flt, options)


def recent_failures(
    events: DataFrame,
    connections: DataFrame,
    flt: EventFilter,
    options: ListOptions = ListOptions(sort="started", failures_only=True),
) -> DataFrame:
    return list_events(events, connections, flt, options)


def event_details(events: DataFrame, connections: DataFrame, wanted: DataFrame) -> DataFrame:
    """Whole events, full text included, for the (connection_id, query_id) pairs of ``wanted``."""
    return with_run_cost(events.join(wanted.select("connection_id", "query_id"), ["connection_id", "query_id"]), connections)


def filter_values(events: DataFrame, flt: EventFilter) -> DataFrame:
    """Menu choices: distinct users and categories of the range, whatever else is filtered."""
    wide = EventFilter(flt.range, connection_id=flt.connection_id, include_internal=True)
    pairs = select_events(events, wide).select("connection_id", "user_name", "query_type").distinct()
    choices = F.array(
        F.struct(F.lit("user_name").alias("kind"), F.col("user_name").alias("value")),
        F.struct(F.lit("query_type").alias("kind"), F.col("query_type").alias("value")),
    )
    return (
        pairs.select("connection_id", F.inline(choices))
        .where(F.col("value").isNotNull())
        .distinct()
        .orderBy("connection_id", "kind", "value")
    )
