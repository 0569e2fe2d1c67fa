import random
from datetime import timedelta

import numpy as np
import pytest
import rows
from pyspark.sql import functions as F
from rows import DAY, NOW, ago

from runledger.functions import pricing
from runledger.operators import charts, reads
from runledger.operators.quantiles import summarize, value_bin
from runledger.plans.dashboard import Dashboard, NotFound
from runledger.plans.params import EventFilter, ListOptions, TimeRange

EVERYTHING = EventFilter(DAY)


def close(value):
    return pytest.approx(value, rel=1e-12)


# Percentiles -----------------------------------------------------------------------------------------------------------


def test_percentiles_interpolate(spark):
    events = rows.events(spark, *[{"total_elapsed_time_ms": 7 * n} for n in range(41)])
    for flt in (EVERYTHING, EventFilter(DAY, connection_id="c")):
        figures = reads.summary(events, rows.connections(spark), flt).first()
        assert (figures.query_count, figures.p50_ms, figures.p95_ms) == (41, close(140.0), close(266.0))


@pytest.mark.parametrize("few_groups", [True, False])
def test_quantiles_match_brute_force(spark, few_groups):
    dice = random.Random(3)
    draw = {
        "hot": lambda: int(dice.lognormvariate(7, 3)),
        "flat": lambda: 5000,
        "wide": lambda: dice.randint(-(2**40), 2**40),
        "edges": lambda: dice.choice([-1, 0, 2047, 2048, 2049, 4095, 4096]),
    }
    data = [(key, make()) for key, make in draw.items() for _ in range(6000 if key == "hot" else 501)]
    data += [("hot", None)] * 7 + [("empty", None)] * 3 + [("single", 9)]
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    found = summarize(
        spark.createDataFrame(data, "k string, v long").repartition(7),
        ["k"],
        "v",
        shares,
        {"n": F.count(F.lit(1))},
        few_groups,
    )
    result = {row.k: row for row in found.collect()}
    assert set(result) == {*draw, "empty", "single"}
    for key, row in result.items():
        values = [v for k, v in data if k == key and v is not None]
        assert row.n == sum(k == key for k, _ in data)
        for name, share in shares.items():
            want = float(np.quantile(np.array(values), share)) if values else None
            assert row[name] == (pytest.approx(want, rel=1e-9, abs=1e-6) if values else None), (key, name)


def test_weighted_rows_count_as_many_runs(spark):
    data = spark.createDataFrame([("a", 10, 3), ("a", 20, 1)], "k string, v long, w long")
    row = summarize(data, ["k"], "v", {"p50": 0.5}, {"n": F.sum("w")}, weight="w").first()
    assert (row.n, row.p50) == (4, 10.0)


def test_value_bins_never_decrease(spark):
    points = sorted({sign * (2**power + step) for power in range(45) for step in (-1, 0, 1) for sign in (-1, 1)})
    data = spark.createDataFrame([(v,) for v in points], "v long")
    bins = [row[1] for row in sorted(data.select("v", value_bin("v")).collect())]
    assert bins == sorted(bins)


# Billing ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "runs, triple",
    [
        ([(4200, 9000), (37, 61), (6, 7)], (4243, 2, 43)),
        ([(2500, None), (-40, 12)], (2500, 1, 0)),
        ([(None, None), (None, None)], (0, 2, 0)),
        ([(None, 1500)], (1500, 0, 0)),
        ([(999, None), (1000, None)], (1999, 1, 999)),
    ],
)
def test_runtime_triple(spark, runs, triple):
    events = rows.events(
        spark, *[{"execution_time_ms": run, "total_elapsed_time_ms": total, "instance_type": "pulse"} for run, total in runs]
    )
    row = reads.summary_by_instance_type(events, rows.connections(spark), EVERYTHING).first()
    assert (row.total_ms, row.sub_second_count, row.sub_second_ms) == triple


def test_minimum_applies_per_run(spark):
    events = rows.events(
        spark,
        {"execution_time_ms": 4000, "instance_type": " Pulse "},
        {"execution_time_ms": 3, "instance_type": " Pulse "},
    )
    for row in (
        reads.summary(events, rows.connections(spark), EVERYTHING).first(),
        reads.summary_by_instance_type(events, rows.connections(spark), EVERYTHING).first(),
        reads.attribution(events, rows.connections(spark), EVERYTHING, "user_name").first(),
    ):
        assert row.estimated_cost_usd == close(5 / 3600 * 0.60)


def test_spelling_variants_are_two_groups_at_one_rate(spark):
    hour = {"execution_time_ms": 3_600_000}
    events = rows.events(spark, {**hour, "instance_type": "Standard"}, {**hour, "instance_type": "standard"})
    found = reads.summary_by_instance_type(events, rows.connections(spark), EVERYTHING).collect()
    assert [(row.instance_type, row.estimated_cost_usd) for row in found] == [
        ("Standard", close(2.4)),
        ("standard", close(2.4)),
    ]


@pytest.mark.parametrize(
    "size, run, elapsed, cost",
    [
        ("standard", 3_600_000, 9_000_000, 2.4),
        ("standard", None, 1_800_000, 1.2),
        ("standard", None, None, None),
        ("standard", -5, None, 0.0),
        ("pulse", None, None, 0.6 / 3600),
        ("pulse", 20, None, 0.6 / 3600),
        ("pulse", 7200_000, None, 1.2),
        ("titan", 3_600_000, None, None),
        (None, 3_600_000, None, None),
    ],
)
def test_cost_of_one_run(spark, size, run, elapsed, cost):
    events = rows.events(spark, {"instance_type": size, "execution_time_ms": run, "total_elapsed_time_ms": elapsed})
    found = reads.with_run_cost(events, rows.connections(spark)).first().estimated_cost_usd
    assert found == (None if cost is None else close(cost))


@pytest.mark.parametrize("tier", ["tier1", "tier2", "tier3", " TIER2 ", "elsewhere"])
def test_group_costs_equal_the_sum_of_run_costs(spark, tier):
    dice = random.Random(5)
    sizes = [*pricing.SIZES, "titan", None]
    events = rows.events(
        spark,
        *[
            {"instance_type": dice.choice(sizes), "execution_time_ms": dice.choice([None, -9, 300, 999, 1000, 70_000])}
            for _ in range(300)
        ],
    )
    connections = rows.connections(spark, {"region_tier": tier})
    single = reads.with_run_cost(events, connections).agg(F.sum("estimated_cost_usd")).first()[0]
    sizes_ = reads.summary_by_instance_type(events, connections, EVERYTHING).agg(F.sum("estimated_cost_usd")).first()[0]
    total = reads.summary(events, connections, EVERYTHING).first().estimated_cost_usd
    buckets = reads.cost_buckets(events, connections, EVERYTHING).agg(F.sum("estimated_cost_usd")).first()[0]
    assert single == pytest.approx(sizes_, rel=1e-9) == pytest.approx(total, rel=1e-9) == pytest.approx(buckets, rel=1e-9)


# Filters ---------------------------------------------------------------------------------------------------------------


def test_filters(spark):
    events = rows.events(
        spark,
        {"query_text": "create view goods_7% as select 1", "query_type": "DDL", "total_elapsed_time_ms": 900},
        {"query_text": "SELECT GoodsX7", "user_name": "bob", "fingerprint": "f"},
        {"is_internal": True},
        {"start_time": DAY.start},
        {"start_time": DAY.end},
        {"connection_id": "other"},
    )

    def found(**options):
        return reads.select_events(events, EventFilter(DAY, **options)).count()

    assert found() == 4
    assert found(connection_id="c") == 3
    assert found(include_internal=True) == 5
    assert found(search="GOODS_7%") == 1
    assert found(search="goodsx") == 1
    assert found(user_name="bob") == 1
    assert found(query_type="DDL") == 1
    assert found(min_duration_ms=900) == 1
    assert found(min_duration_ms=901) == 0
    assert found(fingerprint="f") == 1


def test_lists(spark):
    events = rows.events(
        spark,
        {"total_elapsed_time_ms": 5, "start_time": ago(minutes=3), "query_text": "x" * 2001},
        {"total_elapsed_time_ms": None, "error_type": "TIMEOUT", "start_time": ago(minutes=2)},
        {"total_elapsed_time_ms": 70, "error_type": "SYNTAX_ERROR", "start_time": ago(minutes=9)},
    )
    for flt in (EVERYTHING, EventFilter(DAY, connection_id="c")):
        slow = reads.slow_queries(events, rows.connections(spark), flt).collect()
        assert [row.total_elapsed_time_ms for row in slow] == [70, 5]
        assert not slow[1].is_cut and slow[1].query_text == "x" * 2001
        short = reads.slow_queries(events, rows.connections(spark), flt, ListOptions(limit=None, preview=2000)).collect()
        assert short[1].is_cut and short[1].query_text == "x" * 2000 + "..."
        failed = reads.recent_failures(events, rows.connections(spark), flt).collect()
        assert [row.error_type for row in failed] == ["TIMEOUT", "SYNTAX_ERROR"]
        first = reads.slow_queries(events, rows.connections(spark), flt, ListOptions("started", "asc", 1)).collect()
        assert [row.total_elapsed_time_ms for row in first] == [70]


def test_menu_choices_ignore_other_filters(spark):
    events = rows.events(spark, {"user_name": "bob"}, {"query_type": "DDL", "is_internal": True}, {"user_name": None})
    found = reads.filter_values(events, EventFilter(DAY, user_name="bob")).collect()
    assert [(row.kind, row.value) for row in found] == [
        ("query_type", "DDL"),
        ("query_type", "QUERY"),
        ("user_name", "alice"),
        ("user_name", "bob"),
    ]


# Buckets ---------------------------------------------------------------------------------------------------------------


def test_a_day_has_48_buckets_and_keeps_the_empty_ones(spark):
    events = rows.events(spark, {"total_elapsed_time_ms": 10}, {"start_time": ago(hours=20)})
    chart = reads.latency_buckets(events, rows.connections(spark), EVERYTHING).collect()
    assert len(chart) == 48
    assert sum(row.query_count for row in chart) == reads.summary(events, rows.connections(spark), EVERYTHING).first()[1] == 2
    assert [row.p50_ms for row in chart if row.query_count] == [None, 10.0]


def test_the_last_bucket_is_clipped_at_the_end_of_the_range(spark):
    span = TimeRange(NOW - timedelta(minutes=62), NOW)
    assert span.bucket_seconds == 300 or span.bucket_seconds == 60
    odd = TimeRange(NOW - timedelta(seconds=3690), NOW + timedelta(seconds=15))
    events = rows.events(
        spark, {"start_time": NOW + timedelta(seconds=14)}, {"start_time": NOW + timedelta(seconds=16)}
    )
    for limits in (span, odd):
        chart = reads.latency_buckets(events, rows.connections(spark), EventFilter(limits)).collect()
        inside = reads.select_events(events, EventFilter(limits)).count()
        assert sum(row.query_count for row in chart) == inside


def test_segments_break_at_unmeasured_buckets(spark):
    events = rows.events(
        spark,
        *[{"start_time": ago(minutes=m), "total_elapsed_time_ms": m} for m in (5, 40, 70, 600)],
        {"start_time": ago(minutes=300), "error_type": "E"},
    )
    chart = reads.latency_buckets(events, rows.connections(spark), EVERYTHING)
    assert [row.points for row in charts.latency_segments(chart).collect()] == [1, 3]
    digest = charts.chart_digest(chart).first()
    assert (digest.buckets, digest.total, digest.peak, digest.failures, digest.populated_buckets) == (48, 5, 1, 1, 5)
    assert digest.peak_bucket == digest.first_bucket + timedelta(minutes=14 * 60)


# Attribution -------------------------------------------------------------------------------------------------------------


def _spend(user, hours, **more):
    return {"user_name": user, "execution_time_ms": int(hours * 3_600_000), **more}


def test_attribution_shares_and_previous_period(spark):
    before = {"start_time": ago(hours=30)}
    events = rows.events(spark, _spend("alice", 1), _spend("bob", 0.5), _spend("alice", 0.5, **before))
    alice, bob = reads.attribution(events, rows.connections(spark), EVERYTHING, "user_name").collect()
    assert (alice.key, alice.cost_share, alice.previous_cost_usd) == ("alice", close(2 / 3), close(1.2))
    assert (bob.key, bob.cost_share, bob.previous_cost_usd) == ("bob", close(1 / 3), 0.0)
    assert alice.change_pct == close(100.0) and bob.change_pct is None


def test_a_spender_who_stopped_still_counts_in_the_previous_total(spark):
    events = rows.events(spark, _spend("bob", 1), _spend("alice", 1, start_time=ago(hours=30)))
    connections = rows.connections(spark)
    assert [row.key for row in reads.attribution(events, connections, EVERYTHING, "user_name").collect()] == ["bob"]
    totals = reads.attribution_totals(events, connections, EVERYTHING).first()
    assert (totals.estimated_cost_usd, totals.previous_cost_usd, totals.total_ms) == (close(2.4), close(2.4), 3_600_000)


def test_share_is_zero_when_nothing_costs(spark):
    events = rows.events(spark, {"instance_type": "titan", "user_name": None, "execution_time_ms": 10})
    row = reads.attribution(events, rows.connections(spark), EVERYTHING, "user_name").first()
    assert (row.key, row.cost_share, row.estimated_cost_usd) == ("unknown", 0.0, 0.0)


# One connection ----------------------------------------------------------------------------------------------------------


def test_dashboard_covers_one_connection(spark):
    events = rows.events(spark, {"fingerprint": "f", "total_elapsed_time_ms": 4}, {"connection_id": "other"})
    connections = rows.connections(spark, {}, {"id": "other"})
    shapes = rows.shapes(spark, {"fingerprint": "f"})
    board = Dashboard("c", events, shapes, rows.samples(spark, {"database_name": "d"}), connections)
    flt = board.filter(DAY)
    assert board.summary(flt).first().query_count == 1
    assert len(board.latency(flt).collect()) == 48
    assert board.shapes(flt).first().example_sql == "select 1"
    assert board.shape_statement("f").first().parsed
    assert board.insights(flt).collect() == []
    assert board.storage_by_database().first().database_name == "d"
    assert board.health(NOW).first().health == "pending"
    assert board.event(events.first().query_id).first().query_text == "select 1"
    for unknown in (lambda: board.event("nope"), lambda: board.shape_statement("nope")):
        with pytest.raises(NotFound):
            unknown()
    with pytest.raises(NotFound):
        Dashboard("nobody", events, shapes, rows.samples(spark), connections)


def test_a_change_is_told_from_one_cent_on_as_the_sql_prices_it(spark):
    """Previous costs of exactly one cent, made of two sizes: doubles just below it and just above decide as in the SQL."""
    pairs = [(ms, (3_600_000 - 60 * ms) // 240) for ms in range(1000, 1100, 4)]
    before, now = ago(hours=30), ago(hours=1)
    runs = [
        {"user_name": f"u{ms}", "instance_type": size, "execution_time_ms": spent, "start_time": at}
        for ms, rest in pairs
        for size, spent, at in (("pulse", ms, before), ("standard", rest, before), ("standard", 9000, now))
    ]
    found = reads.attribution(rows.events(spark, *runs), rows.connections(spark), EventFilter(DAY), "user_name")
    told = {row.key: row.change_pct is not None for row in found.collect()}
    want = {f"u{ms}": ms / 1000.0 / 3600.0 * 0.60 + rest / 1000.0 / 3600.0 * 2.40 >= 0.01 for ms, rest in pairs}
    assert told == want and set(want.values()) == {True, False}
