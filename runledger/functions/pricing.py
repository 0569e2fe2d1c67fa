"""Rates and cost expressions. Money is double; what it is computed from stays integer until the last step.

A run's billable time is additive once it is split by size, so one aggregate with a sum per size prices any group:
the per-run minimum is applied before summing and no second grouping by size is needed.

Expressions are SQL text over the event columns and over the rate columns that :func:`rates` adds to a connection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runledger.functions.text import BLANKS

# US dollars per hour by tier and size, dollars per gigabyte-month by tier, and the billing minimum.
SIZES = ("pulse", "standard", "jumbo", "mega", "giga")
HOURLY_USD = {
    "tier1": (0.60, 2.40, 4.80, 12.00, 24.00),
    "tier2": (0.73, 2.93, 5.86, 14.65, 29.30),
    "tier3": (0.77, 3.10, 6.19, 15.48, 30.96),
}
STORAGE_USD_PER_GB_MONTH = {"tier1": 0.04, "tier2": 0.043, "tier3": 0.044}
BYTES_PER_GB = 1_000_000_000
MINIMUM_SIZE = "pulse"
MINIMUM_MS = 1000
# Names the part of the smallest size's time that the minimum stands for.
RAISED = "raised"
DEFAULT_TIER = "tier1"
UNKNOWN = "unknown"

_MS_PER_HOUR = 3_600_000

# Execution time is billed; elapsed time, which includes queueing, stands in only where it is missing.
BILLED_MS = "coalesce(execution_time_ms, total_elapsed_time_ms)"
# One run's billed time, with a missing duration as zero and a negative one clamped.
SPENT_MS = f"greatest(coalesce({BILLED_MS}, 0), 0)"


def cleaned(column: str) -> str:
    """Names compare without surrounding white space and case."""
    return f"lower(btrim({column}, '{BLANKS}'))"


def parse_tier(raw: str) -> str:
    """For input from a person, where a wrong tier is an error."""
    tier = raw.strip().lower()
    if tier not in HOURLY_USD:
        raise ValueError(f"unknown tier {raw!r}; known are {', '.join(HOURLY_USD)}")
    return tier


def stored_tier(column: str) -> Column:
    """For stored rows, where an unknown tier falls back to the first."""
    known = ", ".join(f"'{tier}'" for tier in HOURLY_USD)
    return F.expr(f"case when {cleaned(column)} in ({known}) then {cleaned(column)} else '{DEFAULT_TIER}' end")


def rates(tier: str) -> list[Column]:
    """The rates of a known tier as columns: ``rate_<size>`` by the hour and ``rate_storage`` by the gigabyte-month."""

    def by_tier(values: dict[str, float]) -> str:
        return f"case {tier} " + " ".join(f"when '{name}' then {usd}D" for name, usd in values.items()) + " end"

    hourly = [
        F.expr(by_tier({name: usd[position] for name, usd in HOURLY_USD.items()})).alias(f"rate_{size}")
        for position, size in enumerate(SIZES)
    ]
    return [*hourly, F.expr(by_tier(STORAGE_USD_PER_GB_MONTH)).alias("rate_storage")]


RATE_COLUMNS = (*[f"rate_{size}" for size in SIZES], "rate_storage")


def hourly_rate(size: str) -> str:
    """The rate of the size a column names; null when the size is not known."""
    return f"case {cleaned(size)} " + " ".join(f"when '{name}' then rate_{name}" for name in SIZES) + " end"


def runtime_sums() -> dict[str, Column]:
    """The additive triple behind a group's price. A run with no duration counts as a short run of 0 ms."""
    short = f"coalesce({BILLED_MS}, 0) < {MINIMUM_MS}"
    return {
        "total_ms": F.expr(f"sum({SPENT_MS})"),
        "sub_second_count": F.expr(f"count_if({short})"),
        "sub_second_ms": F.expr(f"sum(case when {short} then {SPENT_MS} else 0 end)"),
    }


def group_cost(size: str) -> Column:
    """Price of a group of one size from its triple. The minimum applies per run; an unknown size costs nothing."""
    raised = (
        "greatest(greatest(total_ms, 0) - greatest(sub_second_ms, 0), 0)"
        f" + greatest(sub_second_count, 0) * {MINIMUM_MS}"
    )
    billable = f"case when {cleaned(size)} = '{MINIMUM_SIZE}' then {raised} else greatest(total_ms, 0) end"
    return F.expr(f"coalesce({billable} * {hourly_rate(size)} / {_MS_PER_HOUR}, 0D)")


def run_cost() -> Column:
    """Price of one run: null for an unknown size, and for a missing duration unless the size has a minimum."""
    floored = f"greatest(coalesce({BILLED_MS}, 0), {MINIMUM_MS})"
    billable = (
        f"case when {cleaned('instance_type')} = '{MINIMUM_SIZE}' then {floored}"
        f" when {BILLED_MS} is not null then greatest({BILLED_MS}, 0) end"
    )
    return F.expr(f"{billable} * {hourly_rate('instance_type')} / {_MS_PER_HOUR}")


def billable_sums(when: str = "true", prefix: str = "billable") -> dict[str, Column]:
    """Billable milliseconds summed per known size, over the rows that meet a condition, and how many of them are what the
    minimum makes of shorter runs."""
    sums = {}
    for name in SIZES:
        spent = f"greatest({SPENT_MS}, {MINIMUM_MS})" if name == MINIMUM_SIZE else SPENT_MS
        counted = f"{cleaned('instance_type')} = '{name}' and ({when})"
        sums[f"{prefix}_{name}"] = F.expr(f"sum(case when {counted} then {spent} else 0 end)")
    short = f"{cleaned('instance_type')} = '{MINIMUM_SIZE}' and coalesce({BILLED_MS}, 0) < {MINIMUM_MS} and ({when})"
    sums[f"{prefix}_{RAISED}"] = F.expr(f"sum(case when {short} then {MINIMUM_MS} else 0 end)")
    return sums


def billable_cost(prefix: str = "billable") -> Column:
    """Price of a group from its :func:`billable_sums`, zero for no group.

    Each size is priced by itself, in seconds, then hours, then dollars, as the SQL does. A cost is compared with fixed
    amounts, so doubles that differ in the last place only would decide differently where it is such an amount exactly.
    """

    def seconds(name: str) -> str:
        spent = f"coalesce({prefix}_{name}, 0)"
        if name != MINIMUM_SIZE:
            return f"{spent} / 1000D"
        raised = f"coalesce({prefix}_{RAISED}, 0)"
        return f"(({spent} - {raised}) / 1000D + {raised} / 1000D)"

    return F.expr(" + ".join(f"{seconds(name)} / 3600D * rate_{name}" for name in SIZES))


def storage_cost(byte_count: str) -> Column:
    """Monthly run rate of holding some bytes."""
    return F.expr(f"greatest({byte_count}, 0) / {BYTES_PER_GB} * rate_storage")
