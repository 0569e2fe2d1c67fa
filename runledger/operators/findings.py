"""Findings: what is worth reviewing, gated by what it cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.operators.reads import first_per_connection
from runledger.operators.shapes import SHAPE_KEY, SHORT_LIST, shape_figures, with_examples, with_flags
from runledger.plans.params import DEFAULT_LIST_LIMIT, EventFilter
from runledger.schema import RUNTIME_FLAGS

# The thresholds.
MIN_COST_SHARE = 0.01
MIN_COST_USD = 0.10
MIN_SPILL_BYTES = 1_000_000_000
MIN_REPEATED_RUNS = 50
MIN_REPEAT_COST_SHARE = 0.02


def raised() -> Column:
    """The findings of one shape row, as an array. Spilling needs no cost: its fix is a bigger size."""
    spilling, repeated = RUNTIME_FLAGS
    cost, share = F.col("estimated_cost_usd"), F.col("cost_share")
    dear = cost >= MIN_COST_USD
    nothing = F.array().cast("array<string>")
    repeats = dear & (F.col("runs") >= MIN_REPEATED_RUNS) & (share >= MIN_REPEAT_COST_SHARE)
    return F.concat(
        F.when(F.col("bytes_spilled") >= MIN_SPILL_BYTES, F.array(F.lit(spilling))).otherwise(nothing),
        F.when(repeats, F.array(F.lit(repeated))).otherwise(nothing),
        F.when(dear & (share >= MIN_COST_SHARE), F.col("antipatterns")).otherwise(nothing),
    )


def detect(figures: DataFrame) -> DataFrame:
    """One row per finding; a shape can raise several."""
    return figures.withColumn("antipattern", F.explode(raised())).drop("antipatterns")


def finding_order() -> list[Column]:
    return [F.desc("estimated_cost_usd"), F.asc("fingerprint"), F.asc("antipattern")]


def all_findings(events: DataFrame, shapes: DataFrame, connections: DataFrame, flt: EventFilter) -> DataFrame:
    return detect(with_flags(shape_figures(events, connections, flt), shapes)).drop("max_ms")


def insights(
    events: DataFrame,
    shapes: DataFrame,
    connections: DataFrame,
    flt: EventFilter,
    limit: int | None = DEFAULT_LIST_LIMIT,
    preview: int | None = None,
) -> DataFrame:
    """The dearest findings with their statement."""
    found = all_findings(events, shapes, connections, flt)
    few = flt.connection_id is not None and limit is not None
    if few:
        top = found.orderBy(*finding_order()).limit(limit)
    else:
        top = first_per_connection(found, finding_order(), limit)
    return with_examples(top, shapes, few and limit <= SHORT_LIST, preview).orderBy("connection_id", *finding_order())


def insight_totals(events: DataFrame, shapes: DataFrame, connections: DataFrame, flt: EventFilter) -> DataFrame:
    """Per kind: shapes and cost, over all findings rather than a capped list. Kinds overlap, so costs must not be added
    up; ``total`` counts the connection's findings."""
    kinds = (
        all_findings(events, shapes, connections, flt)
        .groupBy("connection_id", "antipattern")
        .agg(F.count(F.lit(1)).alias("shapes"), F.sum("estimated_cost_usd").alias("estimated_cost_usd"))
    )
    # at most six kinds per connection reach this window
    total = F.sum("shapes").over(Window.partitionBy("connection_id"))
    return kinds.withColumn("total", total).orderBy("connection_id", F.desc("estimated_cost_usd"), "antipattern")


def by_shape(findings: DataFrame) -> DataFrame:
    """Findings gathered per shape, reasons in order. A shape has at most a handful of kinds, so groups stay tiny."""
    same = [
        F.first(name).alias(name)
        for name in ("estimated_cost_usd", "cost_share", "runs", "bytes_spilled", "last_seen")
    ]
    return (
        findings.groupBy(*SHAPE_KEY)
        .agg(F.array_sort(F.collect_list("antipattern")).alias("reasons"), *same)
        .orderBy("connection_id", F.desc("estimated_cost_usd"), "fingerprint")
    )


def insights_by_shape(events: DataFrame, shapes: DataFrame, connections: DataFrame, flt: EventFilter) -> DataFrame:
    return by_shape(all_findings(events, shapes, connections, flt))
