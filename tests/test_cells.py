"""Reads from the sums beside the slots against reads from the events."""

import random
import uuid
from datetime import timedelta

import pytest
import rows
from rows import NOW

from runledger.operators import cells, reads, shapes
from runledger.plans.params import EventFilter, TimeRange
from runledger.session import scratch_dir
from runledger.sources.tables import Tables

SPAN = TimeRange(NOW - timedelta(hours=36), NOW)


def some_events(spark, numbers, seed):
    dice = random.Random(seed)
    return shapes.fingerprinted(
        rows.events(
            spark,
            *[
                {
                    "query_id": str(uuid.UUID(int=n + 1)),
                    "connection_id": dice.choice("ccd"),
                    "start_time": NOW - timedelta(minutes=7 * n + 1),
                    "query_text": f"select {n} from t{n % 5}",
                    "user_name": dice.choice([None, "a", "b"]),
                    "instance_type": dice.choice([None, "pulse", " Standard ", "odd"]),
                    "total_elapsed_time_ms": dice.choice([None, dice.randrange(4_000_000)]),
                    "execution_time_ms": dice.choice([None, dice.randrange(2000)]),
                    "error_type": dice.choice([None, None, "E"]),
                    "bytes_spilled_to_disk": dice.choice([None, 10]),
                    "is_internal": dice.random() < 0.2,
                }
                for n in numbers
            ],
        )
    )


@pytest.fixture(scope="module")
def tables(spark):
    """Slots, and deltas that change some of their runs and add others."""
    made = Tables(spark, scratch_dir(spark, "tables"))
    made.record_connections(rows.connections(spark, {"id": "c"}, {"id": "d"}, {"id": "quiet"}), 0)
    made.upsert_events(some_events(spark, range(400), 1))
    made.append_events(some_events(spark, range(0, 40, 3), 2), "s", 0)
    return made


def same(left, right):
    def plain(frame):
        return sorted(
            (tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in frame.select(*sorted(frame.columns)).collect()),
            key=repr,
        )

    assert plain(left) == plain(right)


@pytest.mark.parametrize("options", [{}, {"connection_id": "c"}, {"user_name": "a"}, {"include_internal": True}])
def test_cells_answer_as_events_do(tables, options):
    flt = EventFilter(SPAN, **options)
    t, events, connections = tables, tables.events(), tables.connections()
    if "user_name" not in options:
        same(cells.summary_from_cells(t.cells(), t.histogram(), connections, flt, 1), reads.summary(events, connections, flt))
    same(cells.summary_by_instance_type_from_cells(t.cells(), connections, flt, 1), reads.summary_by_instance_type(events, connections, flt))
    same(cells.shape_figures_from_cells(t.cells(), connections, flt, 1), shapes.shape_figures(events, connections, flt))
    half = EventFilter(TimeRange(NOW - timedelta(hours=12), NOW), **options)
    for key in reads.ATTRIBUTION_KEYS:
        same(cells.attribution_from_cells(t.cells(), connections, half, key, 1), reads.attribution(events, connections, half, key))


def test_cells_are_refused_what_they_do_not_know(tables):
    for flt in (
        EventFilter(TimeRange(NOW - timedelta(minutes=90), NOW)),
        EventFilter(SPAN, search="select"),
        EventFilter(SPAN, min_duration_ms=5),
    ):
        with pytest.raises(ValueError, match="cells"):
            cells.select_cells(tables.cells(), flt, 1)
    with pytest.raises(ValueError, match="cells"):
        cells.select_cells(tables.histogram(), EventFilter(SPAN, user_name="a"), 1)


def test_compacted_cells_read_no_events_and_purged_ones_go(spark):
    import io
    from contextlib import redirect_stdout

    made = Tables(spark, scratch_dir(spark, "tables"), 24)
    made.record_connections(rows.connections(spark, {"id": "c"}, {"id": "d"}), 0)
    made.upsert_events(some_events(spark, range(300), 3))
    flt = EventFilter(TimeRange((NOW - timedelta(days=3)).replace(hour=0), NOW.replace(hour=0)))
    frame = cells.summary_from_cells(made.cells(), made.histogram(), made.connections(), flt, 24)
    text = io.StringIO()
    with redirect_stdout(text):
        frame.explain("formatted")
    scans = [line for line in text.getvalue().split("\n") if line.startswith("Location")]
    assert not any("/events]" in line for line in scans) and any("/cells]" in line for line in scans)
    assert text.getvalue().count("PartitionFilters: [isnotnull(start_date") >= 2
    made.purge(spark.createDataFrame([("c",)], "id string"))
    assert {row[0] for row in made.cells().select("connection_id").distinct().collect()} == {"d"}
    assert {row[0] for row in made.histogram().select("connection_id").distinct().collect()} == {"d"}
