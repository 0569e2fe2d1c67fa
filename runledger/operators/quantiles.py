"""Exact interpolated quantiles of integer measures from one read, without gathering a group anywhere.

Runs are counted per (group, value) once, and those counts per value bin. Bins are exact up to 2,047 and about a thousandth
of the value wide above that, so a group has at most some 112,000 of them however many rows it holds. The bins' running
counts tell which one or two bins hold each wanted rank, and only the values of those bins are ranked one by one. Both steps
read the shuffled counts, which are made once. Nothing is sampled or approximated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FINE_BITS = 11  # values below 2 ** 11 have a bin of their own


def value_bin(value: str) -> Column:
    """A bin number that grows with the value."""
    size = f"abs({value})"
    shift = f"cast(case when {size} >= {1 << _FINE_BITS} then floor(log2({size})) - {_FINE_BITS - 1} else 0 end as int)"
    number = f"cast({shift} as bigint) * {1 << _FINE_BITS} + shiftright({size}, {shift})"
    return F.expr(f"case when {value} < 0 then -({number}) else {number} end")


def used_whole(rows: DataFrame) -> Column:
    """A condition that always holds and needs every column, so that Spark does not prune one use of ``rows`` otherwise than
    another and both share one shuffle. A remainder by two is never five."""
    return F.nullif(F.pmod(F.hash(*rows.columns), F.lit(2)), F.lit(5)).isNotNull()


def _ranks(quantiles: dict[str, float], measured: str) -> str:
    """The wanted ranks, counted from zero, as an array."""
    at = [f"{function}(({measured} - 1) * {share}D)" for share in quantiles.values() for function in ("floor", "ceil")]
    return f"array_distinct(array({', '.join(at)}))"


def _interpolated(share: float) -> Column:
    at = f"((_measured - 1) * {share}D)"
    below, above = f"_at[floor({at})]", f"_at[ceil({at})]"
    return F.expr(f"case when _measured > 0 then {below} + ({above} - {below}) * ({at} - floor({at})) end")


def summarize(
    rows: DataFrame,
    keys: list[str],
    value: str,
    quantiles: dict[str, float],
    sums: dict[str, Column],
    few_groups: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """One row per group: the additive ``sums`` and the exact ``quantiles`` of ``value``, null where nothing is measured.
    Rows with a null key belong to no group.

    ``few_groups`` states that the caller bounds the number of groups (the chart of one connection). The list of wanted
    bins is then at most some 250 rows and broadcast. Either way the distinct values per group, counted on the map side
    first, are shuffled once. ``sums`` must add up, as counts and sums do.

    ``weight`` names a column that says how many runs a row stands for; without it every row is one run.
    """
    runs = "1L" if weight is None else weight
    values = (
        rows.where(" and ".join(f"{key} is not null" for key in keys))
        .withColumn("_bin", value_bin(value))
        .groupBy(*keys, "_bin", value)
        .agg(F.expr(f"sum({runs})").alias("_runs"), *[total.alias(name) for name, total in sums.items()])
    )
    # Both uses keep the same columns and filters, so Spark computes the shuffle once.
    values = values.where(used_whole(values))
    bins = values.groupBy(*keys, "_bin").agg(
        F.expr(f"sum(case when {value} is not null then _runs else 0L end)").alias("_n"),
        *[F.sum(name).alias(name) for name in sums],
    )
    group = Window.partitionBy(*keys)
    upto = F.sum("_n").over(group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = bins.select(
        *keys,
        "_bin",
        F.lag("_n").over(group.orderBy("_bin")).isNull().alias("_first"),
        (upto - F.col("_n")).alias("_before"),
        "_n",
        F.sum("_n").over(group).alias("_measured"),
        *[F.sum(name).over(group).alias(name) for name in sums],
    )
    ranks = F.expr(f"filter({_ranks(quantiles, '_measured')}, r -> r >= _before and r < _before + _n)")
    totals = ["_measured", *sums]
    # The bins that hold a wanted rank, and one bin of each group, so that a group without any value has a row.
    wanted = (
        placed.withColumn("_ranks", ranks)
        .where("_first or size(_ranks) > 0")
        .select(
            *[F.col(key).alias(f"_key_{key}") for key in keys], F.col("_bin").alias("_key_bin"), "_before", "_ranks", *totals
        )
    )
    same_bin = " and ".join([f"{key} = _key_{key}" for key in keys] + ["_bin <=> _key_bin"])
    by_value = (
        Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = (
        values.select(*keys, "_bin", value, "_runs")
        .join(F.broadcast(wanted) if few_groups else wanted, F.expr(same_bin))
        .withColumn("_seen", F.col("_before") + F.sum("_runs").over(by_value))
        .select(
            *keys,
            *totals,
            F.expr("explode_outer(filter(_ranks, r -> r >= _seen - _runs and r < _seen))").alias("_rank"),
            F.col(value).alias("_value"),
        )
    )
    at = "map_from_entries(collect_list(struct(_rank, _value)) filter (where _rank is not null))"
    return (
        ranked.groupBy(*keys)
        .agg(F.expr(at).alias("_at"), *[F.max(name).alias(name) for name in totals])
        .select(*keys, *sums, *[_interpolated(share).alias(name) for name, share in quantiles.items()])
    )
