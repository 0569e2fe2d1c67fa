"""The shape of the physical plans: what a cluster would run."""

import io
import re
from contextlib import redirect_stdout
from datetime import timedelta

import pytest
import rows
from rows import DAY, NOW

from runledger.operators import charts, findings, reads, shapes, storage
from runledger.plans import ingest
from runledger.plans.params import EventFilter, TimeRange, timestamp
from runledger.session import scratch_dir
from runledger.sources import history as source
from runledger.sources.tables import Tables


@pytest.fixture(scope="module")
def tables(spark):
    made = Tables(spark, scratch_dir(spark, "tables"))
    events = rows.events(
        spark,
        *[
            {"start_time": NOW - timedelta(hours=n), "total_elapsed_time_ms": n, "query_text": f"select {n} from t{n % 3}"}
            for n in range(72)
        ],
    )
    made.upsert_events(shapes.fingerprinted(events))
    made.register_shapes(made.events())
    made.record_connections(rows.connections(spark), 0)
    return made


def plan(frame) -> str:
    text = io.StringIO()
    with redirect_stdout(text):
        frame.explain("formatted")
    return text.getvalue()


def scans(text: str) -> list[str]:
    """One line per table scan: what it reads and what it is given to skip."""
    return [part.split("\n\n")[0] for part in re.split(r"\n\(\d+\) Scan parquet", text)[1:]]


READS = {
    "summary": lambda t, f: reads.summary(t.events(), t.connections(), f),
    "latency": lambda t, f: reads.latency_buckets(t.events(), t.connections(), f),
    "cost": lambda t, f: reads.cost_buckets(t.events(), t.connections(), f),
    "attribution": lambda t, f: reads.attribution(t.events(), t.connections(), f, "user_name"),
    "slow": lambda t, f: reads.slow_queries(t.events(), t.connections(), f),
    "shapes": lambda t, f: shapes.top_shapes(t.events(), t.shapes(), t.connections(), f),
    "totals": lambda t, f: findings.insight_totals(t.events(), t.shapes(), t.connections(), f),
}


@pytest.mark.parametrize("name", READS)
@pytest.mark.parametrize("connection", [None, "c"])
def test_reads_prune_and_join_on_keys(tables, name, connection):
    text = plan(READS[name](tables, EventFilter(DAY, connection_id=connection)))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition, ENSURE", "PythonUDF", "ArrowEval"):
        assert banned not in text, banned
    on_events = [scan for scan in scans(text) if "start_date" in scan and "/events" in scan]
    assert on_events
    for scan in on_events:
        assert re.search(r"PartitionFilters: \[.*start_date", scan), scan
        assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(start_time.*LessThan\(start_time", scan), scan
        assert connection is None or "EqualTo(connection_id,c)" in scan
        if name != "slow":
            assert "query_text" not in scan.split("ReadSchema")[1], "the long text stays unread"


def test_lists_over_all_connections_prune_before_the_shuffle(tables):
    text = plan(reads.slow_queries(tables.events(), tables.connections(), EventFilter(DAY)))
    assert text.count("WindowGroupLimit") >= 2, "partial and final"


def test_a_list_of_one_connection_is_a_top_n(tables):
    text = plan(reads.slow_queries(tables.events(), tables.connections(), EventFilter(DAY, connection_id="c")))
    assert "TakeOrderedAndProject" in text and "Window" not in text


def test_history_pages_prune_before_the_shuffle(spark):
    page = source.history_page(
        rows.history(spark, {}), ingest.fetch_plan(rows.connections(spark), timedelta(minutes=15)), 5000
    )
    text = plan(page)
    assert text.count("WindowGroupLimit") >= 2
    for ranked in re.findall(r"WindowGroupLimit\nInput[^\n]*", text):
        assert "query_text" not in ranked


def test_an_upsert_reads_only_touched_slots(spark, tables):
    batch = rows.events(spark, {"start_time": NOW})
    text = plan(tables.slots_of(batch))
    assert re.search(r"PartitionFilters: \[.*dynamicpruning", text), text
    found = tables.slots_of(batch)
    assert found.count() == 1


def test_deltas_reach_only_the_slots_they_lie_in(spark):
    made = Tables(spark, scratch_dir(spark, "tables"))
    made.upsert_events(rows.events(spark, *[{"start_time": NOW - timedelta(hours=n)} for n in range(48)]))
    made.append_events(rows.events(spark, {"query_id": "x", "start_time": NOW - timedelta(hours=3)}), "s", 0)
    early = TimeRange(NOW - timedelta(hours=40), NOW - timedelta(hours=30))
    text = plan(reads.select_events(made.events(), EventFilter(early, connection_id="c")).select("query_id"))
    for scan in scans(text):
        assert re.search(r"PartitionFilters: \[.*start_date", scan), scan
        if "/events" in scan:
            assert "EqualTo(connection_id,c)" in scan, scan
            assert "query_text" not in scan.split("ReadSchema")[1]
    # All but the one that tells which deltas are new runs.
    assert sum("/events" in scan and "GreaterThanOrEqual(start_time" in scan for scan in scans(text)) >= 2
    assert made.events().count() == 49


def test_a_lookup_reads_only_the_slots_of_its_keys(tables):
    found = tables.lookup(tables.events().where("total_elapsed_time_ms = 5"))
    assert found.count() == 1
    on_events = [scan for scan in scans(plan(found)) if "/events]" in scan]
    assert any(re.search(r"PartitionFilters: \[.*dynamicpruning", scan) for scan in on_events)


def test_keys_are_looked_up_in_their_folders(spark):
    made = Tables(spark, scratch_dir(spark, "tables"), 24, 8)
    made.upsert_events(rows.events(spark, *[{} for _ in range(40)]))
    found = [scan for scan in scans(plan(made.homes(rows.events(spark, {})))) if "keys/settled" in scan]
    assert found and re.search(r"PartitionFilters: \[.*dynamicpruning", found[0]), found


def test_attribution_scans_both_periods_once(tables):
    flt = EventFilter(TimeRange(NOW - timedelta(hours=6), NOW))
    text = plan(reads.attribution_totals(tables.events(), tables.connections(), flt))
    assert len([scan for scan in scans(text) if "/events" in scan]) == 1


def test_shares_do_not_read_the_events_again(tables):
    for flt in (EventFilter(DAY), EventFilter(DAY, connection_id="c")):
        frame = shapes.shape_figures(tables.events(), tables.connections(), flt)
        frame.write.format("noop").mode("overwrite").save()
        frame.collect()
        final = plan(frame).split("== Initial Plan ==")[0]
        assert "ReusedExchange" in final, final


def final(frame) -> str:
    """The plan as it ran: its tree, and the details of the nodes in it."""
    frame.collect()
    tree, details = plan(frame).split("\n\n\n", 1)
    tree = tree.split("== Initial Plan ==")[0]
    ran = set(re.findall(r"\((\d+)\)", tree))
    parts = re.split(r"\n(?=\(\d+\) )", "\n" + details)
    return tree + "\n" + "\n".join(part for part in parts if re.match(r"\((\d+)\)", part) and re.match(r"\((\d+)\)", part)[1] in ran)


def event_scans(text: str) -> int:
    return len(re.findall(r"\) Scan parquet[^\n]*\n[^\n]*\n[^\n]*\nLocation: [^\n]*/events\]", text))


ONE_SCAN = {
    **{name: READS[name] for name in ("summary", "latency", "cost", "attribution", "shapes", "totals")},
    "digest": lambda t, f: charts.chart_digest(reads.latency_buckets(t.events(), t.connections(), f, False)),
    "segments": lambda t, f: charts.latency_segments(reads.latency_buckets(t.events(), t.connections(), f, False)),
    "insights": lambda t, f: findings.insights(t.events(), t.shapes(), t.connections(), f),
    "by_shape": lambda t, f: findings.insights_by_shape(t.events(), t.shapes(), t.connections(), f),
    "statements": lambda t, f: shapes.shape_statements(t.shapes(), findings.all_findings(t.events(), t.shapes(), t.connections(), f)),
}


@pytest.fixture(scope="module")
def dear(spark):
    """Tables in which shapes cost enough to be findings."""
    made = Tables(spark, scratch_dir(spark, "tables"))
    hours = 3_600_000
    events = [{"start_time": NOW - timedelta(minutes=n + 1), "total_elapsed_time_ms": hours, "query_text": f"select * from t{n % 3}"} for n in range(60)]
    made.load_events(shapes.fingerprinted(rows.events(spark, *events)))
    made.register_shapes(made.events())
    made.record_connections(rows.connections(spark), 0)
    return made


@pytest.mark.parametrize("name", ONE_SCAN)
@pytest.mark.parametrize("connection", [None, "c"])
def test_a_read_scans_the_events_once(dear, name, connection):
    text = final(ONE_SCAN[name](dear, EventFilter(DAY, connection_id=connection)))
    assert event_scans(text) == 1, text


def test_aggregates_over_charts_do_not_sort_all(dear, spark):
    for name in ("digest", "segments"):
        assert "rangepartitioning" not in final(ONE_SCAN[name](dear, EventFilter(DAY)))
    sizes = storage.storage_summary(rows.samples(spark, {"database_name": "a"}), rows.connections(spark))
    assert "rangepartitioning" not in final(sizes)


def test_new_shapes_read_and_normalize_once(dear):
    frame = shapes.register_shapes(dear.shapes(), dear.events())
    text = final(frame)
    assert event_scans(text) == 1 and text.count("WindowGroupLimit") >= 2


def test_fingerprinting_needs_no_shuffle(spark):
    events = rows.events(spark, {}).drop("fingerprint")
    text = plan(shapes.fingerprinted(events))
    assert "Exchange" not in text


def test_sync_state_is_a_plan_not_a_loop(spark):
    connections = rows.connections(spark)
    outcome = ingest.sync_outcome(
        ingest.fetch_plan(connections, timedelta(minutes=15)), ingest.batch_stats(rows.history(spark, {})), 5
    )
    assert ingest.apply_sync_state(connections, outcome, timestamp(NOW)).first().last_success_at == NOW.replace(tzinfo=None)


def test_a_table_is_dealt_to_tasks_of_bounded_size(spark, monkeypatch):
    from runledger import session

    monkeypatch.setattr(session, "ROWS_A_TASK", 100, raising=False)
    path = session.scratch_dir(spark, "numbers")
    spark.range(2000).coalesce(1).write.parquet(path)
    dealt = session.spread(spark.read.parquet(path))
    sizes = [sum(1 for _ in part) for part in dealt.rdd.glom().collect()]
    assert len(sizes) == 20 and sum(sizes) == 2000 and max(sizes) < 200


def test_shuffles_of_a_large_table_begin_with_more_partitions(spark, monkeypatch):
    from runledger import session

    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    name, sized = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before, advised = spark.conf.get(name, None), spark.conf.get(sized)
    try:
        session.size_shuffles(spark, 2000)
        spark.conf.set(sized, "1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1")
        counted = spark.range(2000).selectExpr("hash(id) as k").groupBy("k").count()
        assert max(sum(1 for _ in part) for part in counted.rdd.glom().collect()) < 200
        session.size_shuffles(spark, 5)
        assert spark.conf.get(name) == "20"
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
        spark.conf.set(sized, advised)
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
