"""Sums kept beside the slots of the event table, so that long reads touch cells instead of events.

A cell holds what the runs of one slot add up to for one connection, user, size and shape, own traffic apart; a histogram row
how many of them took how long. Both are additive: cells of any slots, connections or users give the same counts, costs and
exact percentiles as their events. They answer reads whose range ends where slots do and whose filter names nothing but the
connection, the user and whether own traffic counts.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions import pricing
from runledger.operators.quantiles import summarize
from runledger.operators.reads import PERCENTILES, counts, headline, priced_spenders, ranked_spenders, tiers
from runledger.operators.shapes import priced_shapes, shape_sums
from runledger.plans.params import EventFilter, micros

LAYOUT = ["start_date", "start_slot"]
CELL_KEY = ["connection_id", "is_internal", "user_name", "instance_type", "fingerprint"]
_VALUE = "total_elapsed_time_ms"
_HOUR = timedelta(hours=1) // timedelta(microseconds=1)


def _measures() -> dict[str, Column]:
    return {**counts(), **pricing.runtime_sums(), **shape_sums(), **pricing.billable_sums()}


def _added(name: str) -> Column:
    return (F.max if name in ("max_ms", "last_seen") else F.sum)(name).alias(name)


def cells_of(events: DataFrame) -> DataFrame:
    """Cells of events that carry the layout columns."""
    return events.groupBy(*LAYOUT, *CELL_KEY).agg(*[total.alias(name) for name, total in _measures().items()])


def histogram_of(events: DataFrame) -> DataFrame:
    return events.groupBy(*LAYOUT, "connection_id", "is_internal", _VALUE).agg(F.count(F.lit(1)).alias("runs"))


def _begins() -> Column:
    return F.timestamp_micros(F.unix_date("start_date") * F.lit(24 * _HOUR) + F.col("start_slot") * F.lit(_HOUR))


def select_cells(cells: DataFrame, flt: EventFilter, slot_hours: int) -> DataFrame:
    """The cells a filter covers, with ``cell_start``. A range that cuts a slot, or a filter that cells do not know, is an
    error: such a read goes to the events."""
    for moment in (flt.range.start, flt.range.end):
        if micros(moment) % (slot_hours * _HOUR):
            raise ValueError(f"cells answer whole slots of {slot_hours} hours")
    known = EventFilter(flt.range, connection_id=flt.connection_id, include_internal=flt.include_internal, user_name=flt.user_name)
    if flt != known or (flt.user_name is not None and "user_name" not in cells.columns):
        raise ValueError("cells know connections, users and own traffic only")
    first, last = flt.range.dates()
    chosen = cells.where(F.col("start_date").between(F.lit(first), F.lit(last))).withColumn("cell_start", _begins())
    chosen = chosen.where(flt.range.covers("cell_start"))
    if not flt.include_internal:
        chosen = chosen.where(~F.col("is_internal"))
    if flt.connection_id is not None:
        chosen = chosen.where(F.col("connection_id") == flt.connection_id)
    return chosen if flt.user_name is None else chosen.where(F.col("user_name") == flt.user_name)


def summary_from_cells(
    cells: DataFrame, histogram: DataFrame, connections: DataFrame, flt: EventFilter, slot_hours: int
) -> DataFrame:
    """``reads.summary`` without the events."""
    added = [*counts(), *pricing.billable_sums()]
    sums = select_cells(cells, flt, slot_hours).groupBy("connection_id").agg(*[_added(name) for name in added])
    one = flt.connection_id is not None
    spread = summarize(select_cells(histogram, flt, slot_hours), ["connection_id"], _VALUE, PERCENTILES, {}, one, "runs")
    return headline(sums.join(spread, "connection_id", "left"), connections, flt)


def summary_by_instance_type_from_cells(cells: DataFrame, connections: DataFrame, flt: EventFilter, slot_hours: int) -> DataFrame:
    """``reads.summary_by_instance_type`` without the events."""
    size = F.coalesce("instance_type", F.lit(pricing.UNKNOWN)).alias("instance_type")
    names = ["query_count", *pricing.runtime_sums()]
    groups = select_cells(cells, flt, slot_hours).groupBy("connection_id", size).agg(*[_added(name) for name in names])
    priced = groups.join(tiers(connections, flt), "connection_id")
    return priced.select(
        "connection_id", "instance_type", *names, pricing.group_cost("instance_type").alias("estimated_cost_usd")
    ).orderBy("connection_id", F.desc("query_count"), "instance_type")


def attribution_from_cells(cells: DataFrame, connections: DataFrame, flt: EventFilter, key: str, slot_hours: int) -> DataFrame:
    """``reads.attribution`` without the events."""
    now = flt.range.covers("cell_start")

    def of(period: str, name: str) -> Column:
        return F.expr(f"sum(case when {period} then {name} else 0 end)")

    chosen = select_cells(cells, flt.over(flt.range.with_previous()), slot_hours)
    groups = chosen.groupBy("connection_id", F.coalesce(key, F.lit(pricing.UNKNOWN)).alias("key")).agg(
        *[of(now, name).alias(name) for name in ("query_count", "failure_count", "total_ms")],
        *[of(now, name).alias(name.replace("billable", "current", 1)) for name in pricing.billable_sums()],
        *[of(f"not ({now})", name).alias(name.replace("billable", "previous", 1)) for name in pricing.billable_sums()],
    )
    return ranked_spenders(priced_spenders(groups, connections, flt), flt)


def shape_figures_from_cells(cells: DataFrame, connections: DataFrame, flt: EventFilter, slot_hours: int) -> DataFrame:
    """``shapes.shape_figures`` without the events."""
    names = [*shape_sums(), *pricing.billable_sums()]
    added = [_added(name) for name in names]
    chosen = select_cells(cells, flt, slot_hours).where(F.col("fingerprint").isNotNull())
    groups = chosen.groupBy("connection_id", "fingerprint").agg(
        F.sum("query_count").alias("runs"), F.sum("failure_count").alias("failure_count"), F.sum("total_ms").alias("total_ms"), *added
    )
    return priced_shapes(groups, connections, flt)
