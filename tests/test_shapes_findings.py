import pytest
import rows
from pyspark.sql import functions as F
from rows import DAY, ago

from runledger.operators import findings, shapes, storage
from runledger.plans.params import EventFilter

EVERYTHING = EventFilter(DAY)


def figures(spark, **changes):
    base = {
        "connection_id": "c",
        "fingerprint": "f",
        "runs": 1,
        "failure_count": 0,
        "total_ms": 0,
        "bytes_spilled": 0,
        "estimated_cost_usd": 0.0,
        "cost_share": 0.0,
        "antipatterns": [],
    }
    schema = (
        "connection_id string, fingerprint string, runs long, failure_count long, total_ms long, bytes_spilled long, "
        "estimated_cost_usd double, cost_share double, antipatterns array<string>"
    )
    return spark.createDataFrame([tuple({**base, **changes}.values())], schema)


@pytest.mark.parametrize(
    "changes, kinds",
    [
        (dict(bytes_spilled=1_000_000_000), ["spilling"]),
        (dict(bytes_spilled=999_999_999, estimated_cost_usd=5.0, cost_share=0.5), []),
        (dict(runs=50, estimated_cost_usd=0.10, cost_share=0.02), ["repeated_runs"]),
        (dict(runs=49, estimated_cost_usd=0.10, cost_share=0.02), []),
        (dict(runs=50, estimated_cost_usd=0.09, cost_share=0.5), []),
        (dict(runs=50, estimated_cost_usd=0.10, cost_share=0.019), []),
        (dict(antipatterns=["select_star", "no_filter"], estimated_cost_usd=0.1, cost_share=0.01), ["no_filter", "select_star"]),
        (dict(antipatterns=["select_star"], estimated_cost_usd=0.1, cost_share=0.009), []),
        (
            dict(runs=60, bytes_spilled=2_000_000_000, antipatterns=["cross_join"], estimated_cost_usd=1.0, cost_share=1.0),
            ["cross_join", "repeated_runs", "spilling"],
        ),
    ],
)
def test_rules(spark, changes, kinds):
    assert sorted(row.antipattern for row in findings.detect(figures(spark, **changes)).collect()) == kinds


def _hour(fingerprint, **more):
    return {"fingerprint": fingerprint, "execution_time_ms": 3_600_000, **more}


def test_ranked_shapes(spark):
    events = rows.events(
        spark,
        _hour("a", bytes_spilled_to_disk=7, total_elapsed_time_ms=-3),
        _hour("b"),
        _hour("b", error_type="E", total_elapsed_time_ms=9, instance_type="jumbo", start_time=ago(minutes=1)),
        _hour(None),
    )
    table = rows.shapes(spark, {"fingerprint": "b", "example_sql": "y" * 2500, "antipatterns": ["select_star", "from_later"]})
    for flt in (EVERYTHING, EventFilter(DAY, connection_id="c")):
        b, a = shapes.top_shapes(events, table, rows.connections(spark), flt, None, 2000).collect()
        assert (b.fingerprint, b.runs, b.failure_count, b.max_ms, b.is_cut) == ("b", 2, 1, 9, True)
        assert b.antipatterns == ["select_star"] and b.copy_sql.endswith("not complete.")
        assert b.cost_share == pytest.approx(7.2 / 9.6) and b.estimated_cost_usd == pytest.approx(7.2)
        assert (a.example_sql, a.antipatterns, a.bytes_spilled, a.max_ms) == ("", [], 7, 0)
        (only,) = shapes.top_shapes(events, table, rows.connections(spark), flt, limit=1).collect()
        assert only.cost_share == pytest.approx(7.2 / 9.6), "a cap leaves shares alone"


def test_findings_totals_and_groups(spark):
    events = rows.events(spark, _hour("a", bytes_spilled_to_disk=2_000_000_000), _hour("b"), _hour("b"))
    table = rows.shapes(spark, {"fingerprint": "a", "antipatterns": ["no_filter"]}, {"fingerprint": "b", "antipatterns": ["no_filter"]})
    connections = rows.connections(spark)
    listed = findings.insights(events, table, connections, EVERYTHING).collect()
    assert [(row.fingerprint, row.antipattern) for row in listed] == [("b", "no_filter"), ("a", "no_filter"), ("a", "spilling")]
    totals = findings.insight_totals(events, table, connections, EVERYTHING).collect()
    assert [(row.antipattern, row.shapes, round(row.estimated_cost_usd, 6), row.total) for row in totals] == [
        ("no_filter", 2, 7.2, 3),
        ("spilling", 1, 2.4, 3),
    ]
    assert len(findings.insights(events, table, connections, EVERYTHING, limit=2).collect()) == 2
    grouped = findings.insights_by_shape(events, table, connections, EVERYTHING).collect()
    assert [(row.fingerprint, row.reasons) for row in grouped] == [("b", ["no_filter"]), ("a", ["no_filter", "spilling"])]


def test_a_shape_keeps_its_first_example(spark):
    early = rows.events(spark, {"query_text": "select a from t where n = 1", "start_time": ago(minutes=9)})
    late = rows.events(
        spark,
        {"query_text": "select a from t where n = 2", "start_time": ago(minutes=20)},
        {"query_text": "select * from u", "start_time": ago(minutes=1)},
        {"query_text": "select *  from u -- again", "start_time": ago(minutes=0)},
    )
    table = shapes.new_shapes(early)
    both = {row.example_sql: row for row in shapes.register_shapes(table, late).collect()}
    assert set(both) == {"select a from t where n = 1", "select * from u"}
    assert both["select * from u"].antipatterns == ["select_star", "no_filter"]
    assert both["select a from t where n = 1"].antipatterns == []


def test_flag_backfill_marks_clean_shapes_as_examined(spark):
    table = rows.shapes(
        spark,
        {"fingerprint": "a", "antipatterns": None, "example_sql": "select a from t where b = 1"},
        {"fingerprint": "b", "antipatterns": None, "example_sql": "select * from t where a = 1", "first_seen": ago(days=9)},
        {"fingerprint": "c", "antipatterns": ["no_filter"]},
    )
    assert [row.fingerprint for row in shapes.pending_flags(table, 1).collect()] == ["b"]
    done = shapes.backfill_flags(table, shapes.pending_flags(table, 10))
    assert {row.fingerprint: row.antipatterns for row in done.collect()} == {"a": [], "b": ["select_star"], "c": ["no_filter"]}
    assert shapes.pending_flags(done, 10).count() == 0


def test_storage(spark):
    gb = 1_000_000_000
    samples = rows.samples(
        spark,
        {"database_name": "small", "active_bytes": gb},
        {"database_name": "big", "active_bytes": 5 * gb, "historical_bytes": gb},
        {"database_name": "big", "active_bytes": 50 * gb, "computed_at": ago(days=1)},
    )
    connections = rows.connections(spark, {}, {"id": "none"})
    listed = storage.storage_by_database(samples, connections).collect()
    assert [(row.database_name, row.total_bytes) for row in listed] == [("big", 6 * gb), ("small", gb)]
    held = {row.connection_id: row for row in storage.storage_summary(samples, connections).collect()}
    assert held["c"].total_bytes == 7 * gb and held["c"].estimated_monthly_cost_usd == pytest.approx(0.28)
    assert (held["none"].total_bytes, held["none"].computed_at) == (0, None)
    again = storage.append_samples(samples, samples.withColumn("active_bytes", F.lit(1)))
    assert sorted(again.collect()) == sorted(samples.collect())


def test_byte_totals_stay_at_the_largest_long(spark):
    samples = rows.samples(spark, {"database_name": "d", "active_bytes": 2**63 - 1, "failsafe_bytes": 5})
    assert samples.select(storage.total_bytes()).first()[0] == 2**63 - 1
