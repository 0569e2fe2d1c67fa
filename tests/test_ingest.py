import uuid
from datetime import timedelta

import pytest
import rows
from pyspark.sql import functions as F
from rows import NOW, ago

from runledger.functions.timebins import interval_ms
from runledger.operators import health, merge
from runledger.plans import ingest
from runledger.plans.params import timestamp
from runledger.schema import EVENTS
from runledger.session import scratch_dir
from runledger.sources import history as source
from runledger.sources.tables import LAYOUT, Tables
from runledger.streaming import live

MS = 1_714_564_800_000  # NOW
ID = "00000000-0000-0000-0000-0000000000ff"


def table(frame):
    return sorted(map(str, frame.select(*EVENTS.names).collect()))


# Source ------------------------------------------------------------------------------------------------------------------


def test_malformed_rows_are_set_aside_and_counted(spark):
    page = rows.history(
        spark,
        {"query_id": ID.upper()},
        {"query_id": ID.replace("-", "")},
        {"query_id": f"{{{ID}}}"},
        {"query_id": f"urn:uuid:{ID}"},
        {"query_id": "not-a-uuid"},
        {"query_id": None},
        {"query_id": ID.replace("-", "", 1)},
        {"start_ms": 9_000_000_000_000_000},
        {"start_ms": None},
        {"query_text": None, "end_ms": 9_000_000_000_000_000},
    )
    good = source.readable_rows(page).collect()
    assert [row.query_id for row in good] == [ID] * 4 + [str(uuid.UUID(int=10))]
    assert (good[-1].query_text, good[-1].end_time) == ("", None)
    assert source.unreadable_rows(page).count() == 5
    counts = source.page_counts(page).first()
    assert (counts.rows_returned, counts.unreadable) == (10, 5)


def test_own_traffic_is_recognised_by_agent_or_marker(spark):
    drafts = source.readable_rows(
        rows.history(
            spark,
            {"user_agent": "client/1 SelfWatch"},
            {"user_agent": None},
            {"query_text": "-- selfwatch\nselect 1"},
            {"user_agent": "client/1"},
        )
    )
    found = source.to_events(drafts, timestamp(NOW)).orderBy("query_id").collect()
    assert [row.is_internal for row in found] == [True, False, True, False]
    assert all(row.fingerprint is None for row in found)


def test_pages_are_inclusive_oldest_first_and_limited(spark):
    history = rows.history(
        spark,
        *[{"start_ms": MS + n} for n in range(5)],
        *[{"connection_id": "d", "start_ms": MS - n} for n in range(3)],
        {"connection_id": "off"},
    )
    plan = spark.createDataFrame([("c", NOW + timedelta(milliseconds=1)), ("d", None)], "connection_id string, since timestamp")
    page = source.history_page(history, plan, 3).collect()
    assert sorted((row.connection_id, row.start_ms - MS) for row in page) == [
        ("c", 1), ("c", 2), ("c", 3), ("d", -2), ("d", -1), ("d", 0),
    ]


@pytest.mark.parametrize("limit", [1, 2, 3, 100])
def test_drained_pages_hold_every_row_once(spark, limit):
    at = [{"start_ms": MS + n // 4, "query_id": str(uuid.UUID(int=n))} for n in range(9)]
    history = rows.history(spark, *at, {"connection_id": "d", "start_ms": None}, {"connection_id": "d", "start_ms": MS}, {"connection_id": "off"})
    plan = spark.createDataFrame([("c", NOW), ("d", None)], "connection_id string, since timestamp")
    pages = source.drained(history, plan, limit, lambda page: ingest.staged(page, scratch_dir(spark, "page")))
    found = [(row.connection_id, row.query_id, row.start_ms) for page in pages for row in page.collect()]
    assert len(found) == len(set(found)) == 11
    assert all(page.where("connection_id = 'c'").count() <= limit for page in pages)


def test_intervals_become_milliseconds(spark):
    spans = spark.sql("select interval '1 02:03:04.567' day to second as i union all select interval '-0.5' second")
    assert [row[0] for row in spans.select(interval_ms(F.col("i"))).collect()] == [93_784_567, -500]
    raw = spark.sql("select timestamp '1970-01-01 00:00:01.5' as s, interval '2' second as e")
    assert tuple(source.with_epoch_ms(raw, {"s": "start_ms"}, {"e": "execution_time_ms"}).first()) == (1500, 2000)


def test_storage_scan_drops_deleted_databases(spark):
    raw = spark.createDataFrame(
        [("c", "live", NOW, 5, None, 1, 2, None), ("c", "gone", NOW, 5, 5, 5, 5, NOW), ("c", None, NOW, None, None, None, None, None)],
        "connection_id string, database_name string, computed_at timestamp, active_bytes long, historical_bytes long, "
        "retained_for_clone_bytes long, failsafe_bytes long, deleted_ts timestamp",
    )
    found = source.storage_scan(raw, timestamp(NOW)).collect()
    assert [(row.database_name, row.active_bytes, row.historical_bytes) for row in found] == [("live", 5, 0), ("", 0, 0)]


# Upsert ------------------------------------------------------------------------------------------------------------------


def test_upsert_policies(spark):
    stored = rows.events(
        spark,
        {
            "query_text": "old",
            "end_time": NOW,
            "error_type": "E",
            "user_name": "alice",
            "bytes_spilled_to_disk": 7,
            "fingerprint": "f",
        },
    )
    batch = rows.events(
        spark,
        {
            "query_text": "new",
            "start_time": ago(hours=9),
            "end_time": None,
            "error_type": None,
            "user_name": None,
            "bytes_spilled_to_disk": 9,
            "user_agent": "client selfwatch",
            "is_internal": True,
            "ingested_at": NOW + timedelta(minutes=1),
        },
        {"query_text": "second"},
    )
    merged, fresh = merge.upsert_events(stored, batch).orderBy("query_id").collect()
    assert (merged.query_text, merged.start_time) == ("old", stored.first().start_time), "first wins"
    assert (merged.end_time, merged.error_type, merged.is_internal) == (None, None, True), "last wins, null included"
    assert (merged.user_name, merged.bytes_spilled_to_disk, merged.fingerprint) == ("alice", 9, "f"), "last known wins"
    assert fresh.query_text == "second"


def _random_reads(spark, count=400, keys=60, seed=1):
    import random

    dice = random.Random(seed)
    return [
        {
            "query_id": str(uuid.UUID(int=dice.randrange(keys))),
            "connection_id": dice.choice("cd"),
            "execution_time_ms": dice.choice([None, dice.randrange(9999)]),
            "user_name": dice.choice([None, "a", "b"]),
            "query_type": dice.choice([None, "QUERY", "DDL"]),
            "ingested_at": NOW + timedelta(seconds=step),
        }
        for step in range(count)
    ]


def test_any_split_into_batches_ends_in_the_same_table(spark):
    reads = _random_reads(spark)
    for row in reads:  # what a source keeps constant
        row["start_time"] = ago(minutes=int(row["query_id"][-2:], 16))
    whole = rows.events(spark, *reads)
    folded = merge.fold_deliveries(whole, "ingested_at")
    empty = rows.events(spark).limit(0)
    for size in (150, 400):
        step_by_step = empty
        for start in range(0, len(reads), size):
            batch = rows.events(spark, *reads[start : start + size])
            step_by_step = spark.createDataFrame(merge.upsert_events(step_by_step, batch).collect(), EVENTS)
        assert table(step_by_step) == table(folded)


def test_repeats_in_a_batch_follow_the_delivery_number(spark):
    one = {"query_id": str(uuid.UUID(int=5))}
    running = {**one, "user_name": "alice", "end_time": None, "total_elapsed_time_ms": None}
    done = {**one, "user_name": None, "end_time": NOW, "total_elapsed_time_ms": 900}
    for first, second in ((running, done), (done, running)):
        batch = rows.events(spark, first).withColumn("seq", F.lit(1)).unionByName(rows.events(spark, second).withColumn("seq", F.lit(2)))
        (row,) = merge.upsert_events(rows.events(spark).limit(0), batch).collect()
        assert (row.user_name, row.total_elapsed_time_ms) == ("alice", second["total_elapsed_time_ms"])
    # Without a number, a run that has ended was read after one that had not.
    (row,) = merge.upsert_events(rows.events(spark).limit(0), rows.events(spark, done, running)).collect()
    assert (row.user_name, row.total_elapsed_time_ms) == ("alice", 900)


def test_different_reads_under_one_delivery_number_are_an_error(spark):
    one = {"query_id": str(uuid.UUID(int=5))}
    same = rows.events(spark, one, one).withColumn("seq", F.lit(1))
    assert merge.one_per_key(same).count() == 1
    tied = rows.events(spark, one, {**one, "user_agent": "client"}).withColumn("seq", F.lit(1))
    with pytest.raises(Exception, match="different reads under one delivery number"):
        merge.one_per_key(tied).collect()


def test_without_a_number_the_read_that_knows_more_comes_last(spark):
    done = {"query_id": str(uuid.UUID(int=5)), "end_time": NOW, "total_elapsed_time_ms": 900}
    own = {**done, "user_agent": "selfwatch", "is_internal": True}
    for reads in ((done, own), (own, done)):
        (row,) = merge.one_per_key(rows.events(spark, *reads)).collect()
        assert (row.user_agent, row.is_internal) == ("selfwatch", True)


def test_a_replacement_cut_short_is_completed(spark, monkeypatch):
    import shutil

    tables = Tables(spark, scratch_dir(spark, "tables"), 24)
    old = rows.events(spark, *[{"start_time": ago(minutes=n)} for n in range(3)])
    tables.upsert_events(old)
    publish = Tables._publish

    def dies(self, placed, path):
        if path == self._events:  # the driver dies after the folders were deleted
            shutil.rmtree(self._events)
            raise RuntimeError("lost")
        publish(self, placed, path)

    monkeypatch.setattr(Tables, "_publish", dies)
    with pytest.raises(RuntimeError, match="lost"):
        tables.upsert_events(rows.events(spark, {"query_id": str(uuid.UUID(int=77))}))
    monkeypatch.setattr(Tables, "_publish", publish)
    again = Tables(spark, tables._events.removesuffix("/events"), 24)
    again.recover()
    assert again.events().count() == 4
    again.recover()
    assert again.events().count() == 4
    again.compact()
    assert again.events().count() == 4 and not again.pending_batches()


def root_of(tables):
    return tables._events.removesuffix("/events")


def runs(spark, numbers, **changes):
    return rows.events(spark, *[{"query_id": str(uuid.UUID(int=n + 1)), "start_time": ago(hours=n), **changes} for n in numbers])


def test_a_moved_start_stays_one_row_before_and_after_compaction(spark):
    tables = Tables(spark, scratch_dir(spark, "tables"), 1, 4)
    tables.append_events(runs(spark, range(6)), "a", 0)
    tables.compact()
    tables.append_events(runs(spark, range(4, 9)), "a", 1)
    tables.append_events(runs(spark, range(9), start_time=ago(days=9), error_type="late"), "b", 0)
    want = sorted((str(uuid.UUID(int=n + 1)), (NOW - timedelta(hours=n)).replace(tzinfo=None), "late") for n in range(9))
    for _ in range(2):
        got = tables.events()
        assert sorted((r.query_id, r.start_time, r.error_type) for r in got.collect()) == want
        slots = {(r.start_date, r.start_slot) for r in got.collect()}
        assert {(r.start_date, r.start_slot) for r in tables.placed(got.select("start_time")).collect()} == slots
        tables.compact()
    assert tables.homes(got).count() == 9


def test_repeating_any_batch_changes_nothing(spark):
    tables = Tables(spark, scratch_dir(spark, "tables"), 24, 4)
    batches = [runs(spark, range(n, n + 5), execution_time_ms=n, user_name=None if n % 2 else f"u{n}") for n in range(5)]

    def same():
        want = None
        for number, batch in enumerate(batches):
            want = batch if want is None else merge.upsert_events(want, batch)
        return table(tables.events()) == table(want)

    for number, batch in enumerate(batches):
        tables.append_events(batch, "s", number)
        tables.append_events(batch, "s", number)
    for number in (0, 3, 1):
        tables.append_events(batches[number], "s", number)
        assert same()
    tables.compact()
    for number in (4, 0):
        tables.append_events(batches[number], "s", number)
    assert same() and not tables.pending_batches()


@pytest.mark.parametrize("dies_in", ["_publish", "_finish", "_settle", "settled_upto"])
def test_compaction_cut_short_anywhere_loses_and_repeats_nothing(spark, monkeypatch, dies_in):
    tables = Tables(spark, scratch_dir(spark, "tables"), 24, 2)
    tables.upsert_events(runs(spark, range(3)))
    tables.append_events(runs(spark, range(2, 6), error_type="E"), "s", 0)
    want = table(tables.events())
    # After the slots were replaced, the keys settled or the folders deleted.
    calls = {"_publish": 1, "_finish": 0, "_settle": 0, "settled_upto": 0}[dies_in]
    real, seen = getattr(Tables, dies_in), []

    def dies(self, *args):
        seen.append(1)
        if len(seen) > calls:
            raise RuntimeError("lost")
        return real(self, *args)

    monkeypatch.setattr(Tables, dies_in, dies)
    with pytest.raises(RuntimeError, match="lost"):
        tables.compact()
    monkeypatch.setattr(Tables, dies_in, real)
    again = Tables(spark, root_of(tables), 24, 2)
    assert table(again.events()) == want
    again.recover()
    again.compact()
    assert table(again.events()) == want and again.homes(again.events()).count() == 6


def test_folders_stay_few_over_many_batches(spark):
    import glob

    tables = Tables(spark, scratch_dir(spark, "tables"), 24, 2)
    tables.record_connections(rows.connections(spark), 0)
    for number in range(50):
        tables.append_events(runs(spark, [number % 7], execution_time_ms=number), "s", number)
        tables.compact(10)
        tables.advance_connections(lambda state: state.withColumn("name", F.lit(f"n{number}")), "s", number)
    folders = {name: len(glob.glob(f"{root_of(tables)}/{name}")) for name in ("deltas/*/*", "keys/recent/*/*", "done/*/*", "connections/pass=*")}
    assert folders["deltas/*/*"] < 10 and folders["keys/recent/*/*"] < 10 and folders["done/*/*"] == 1 and folders["connections/pass=*"] == 2
    assert sorted(r.execution_time_ms for r in tables.events().collect()) == list(range(43, 50))
    assert tables.connections().first().name == "n49"


def test_a_repeated_batch_counts_once_in_the_books(spark):
    tables = Tables(spark, scratch_dir(spark, "tables"), 24)
    tables.record_connections(rows.connections(spark, {"name": ""}), 0)
    for number in (0, 1, 1, 2, 2, 2):
        tables.advance_connections(lambda state: state.withColumn("name", F.concat("name", F.lit(str(number)))), "s", number)
    assert tables.connections().first().name == "012"


@pytest.mark.parametrize("step", ["delete", "rename"])
def test_a_table_replaced_whole_survives_the_death_of_the_driver(spark, monkeypatch, step):
    from runledger.sources import tables as stored

    tables = Tables(spark, scratch_dir(spark, "tables"), 24)
    tables.register_shapes(rows.events(spark, *[{"query_text": f"select {n} from t{n}"} for n in range(5)]))
    shapes = tables.shapes().withColumn("antipatterns", F.lit(None).cast("array<string>")).collect()
    spark.createDataFrame(shapes, tables.shapes().schema).write.mode("overwrite").parquet(tables._shapes)
    real = stored.delete

    def dies(*args):
        if step == "rename":
            real(*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(stored, "delete", dies)
    with pytest.raises(RuntimeError, match="lost"):
        tables.backfill_flags()
    monkeypatch.setattr(stored, "delete", real)
    again = Tables(spark, root_of(tables), 24)
    assert again.shapes().count() == 5
    again.recover()
    assert again.shapes().where("antipatterns is not null").count() == 5
    again.backfill_flags()
    assert again.shapes().count() == 5


def test_a_purge_rewrites_only_slots_of_the_connection(spark):
    tables = Tables(spark, scratch_dir(spark, "tables"), 24, 2)
    tables.upsert_events(
        rows.events(
            spark,
            {"connection_id": "c", "start_time": ago(days=1)},
            {"connection_id": "d", "start_time": ago(days=1)},
            {"connection_id": "c", "start_time": ago(days=2)},
            {"connection_id": "d", "start_time": ago(days=3)},
        )
    )
    files = {path for path in tables.events().inputFiles() if "2024-04-28" in path}
    tables.purge(spark.createDataFrame([("c",)], "id string"))
    left = tables.events()
    assert sorted(r.connection_id for r in left.collect()) == ["d", "d"]
    assert files and files <= set(left.inputFiles()) and len(left.inputFiles()) == 2
    assert tables.homes(rows.events(spark, {"connection_id": "c"}, {}, {"connection_id": "c"})).count() == 0


def test_purge_leaves_nothing_of_a_connection(spark):
    tables = Tables(spark, scratch_dir(spark, "tables"), 24)
    tables.upsert_events(rows.events(spark, {"connection_id": "c"}, {"connection_id": "d"}))
    tables.register_shapes(tables.events())
    tables.record_connections(rows.connections(spark, {"id": "c"}, {"id": "d"}), 1)
    tables.purge(spark.createDataFrame([("c",)], "id string"))
    for table_, name in ((tables.events(), "connection_id"), (tables.shapes(), "connection_id"), (tables.connections(), "id")):
        assert [row[0] for row in table_.select(name).distinct().collect()] == ["d"]


def test_upserting_twice_changes_nothing(spark):
    batch = rows.events(spark, *_random_reads(spark, seed=2))
    once = merge.upsert_events(rows.events(spark).limit(0), batch)
    assert table(merge.upsert_events(once, batch)) == table(once)


@pytest.mark.parametrize("slot_hours", [1, 24])
def test_stored_upsert_rewrites_only_touched_slots(spark, slot_hours):
    tables = Tables(spark, scratch_dir(spark, "tables"), slot_hours)
    old = rows.events(spark, {"start_time": ago(days=3)}, {"start_time": ago(minutes=50), "connection_id": "d"})
    tables.upsert_events(old)
    files = set(tables.events().inputFiles())
    late = rows.events(
        spark, {"query_id": ID}, {"query_id": str(uuid.UUID(int=2)), "connection_id": "d", "start_time": ago(minutes=50), "error_type": "E"}
    )
    tables.upsert_events(late)
    tables.upsert_events(late)
    assert table(tables.events()) == table(merge.upsert_events(old, late))
    kept = files & set(tables.events().inputFiles())
    assert len(kept) == 1 and "2024-04-28" in kept.pop()


def test_backfills(spark):
    tables = Tables(spark, scratch_dir(spark, "tables"), 24)
    tables.replace_slots(
        rows.events(
            spark,
            {"query_text": "select 1", "start_time": ago(days=2)},
            {"query_text": "select 2", "start_time": ago(days=1)},
            {"query_text": "select a from t", "fingerprint": "kept"},
        )
    )
    ingest.backfill(tables, scratch_dir(spark, "staging"), 1)
    assert [row.query_text for row in tables.events().where("fingerprint is null").collect()] == ["select 1"]
    ingest.backfill(tables, scratch_dir(spark, "staging"), 1)
    stamped = {row.query_text: row.fingerprint for row in tables.events().collect()}
    assert stamped["select 1"] == stamped["select 2"] and stamped["select a from t"] == "kept"
    assert tables.shapes().count() == 1
    assert tables.events().count() == 3


def test_purge(spark):
    events = rows.events(spark, {}, {"connection_id": "gone"})
    gone = rows.connections(spark, {"id": "gone"})
    assert [row.connection_id for row in merge.purge(events, gone).collect()] == ["c"]


# Passes ------------------------------------------------------------------------------------------------------------------


def test_fetch_plan(spark):
    connections = rows.connections(
        spark,
        {"id": "new"},
        {"id": "steady", "watermark_start_time": NOW},
        {"id": "behind", "watermark_start_time": NOW, "catching_up": True},
        {"id": "off", "enabled": False},
    )
    plan = {row.connection_id: row.since for row in ingest.fetch_plan(connections, timedelta(minutes=15)).collect()}
    naive = NOW.replace(tzinfo=None)
    assert plan == {"new": None, "steady": naive - timedelta(minutes=15), "behind": naive}


@pytest.mark.parametrize(
    "state, stats, expected",
    [  # (watermark, catching up), (returned, lost, newest) -> (watermark, full, succeeded, error?, warning?)
        ((None, False), None, (None, False, True, False, False)),
        ((0, False), None, (0, False, True, False, False)),
        ((0, False), (3, 0, 5), (5, True, True, False, False)),
        ((9, False), (2, 0, 5), (9, False, True, False, False)),
        ((0, True), (3, 0, 0), (0, True, False, True, False)),
        ((0, True), (3, 3, None), (0, True, False, True, False)),
        ((0, False), (3, 0, 0), (0, True, True, False, False)),
        ((0, True), (3, 1, 4), (4, True, True, False, True)),
        ((0, True), (2, 0, 0), (0, False, True, False, False)),
    ],
)
def test_sync_outcome(spark, state, stats, expected):
    def at(minutes):
        return None if minutes is None else NOW + timedelta(minutes=minutes)

    connections = rows.connections(spark, {"watermark_start_time": at(state[0]), "catching_up": state[1]})
    found = [("c", stats[0], stats[1], at(stats[2]))] if stats else []
    stats = spark.createDataFrame(found, "connection_id string, rows_returned long, unreadable long, newest timestamp")
    plan = ingest.fetch_plan(connections, timedelta(minutes=15))
    row = ingest.sync_outcome(plan, stats, 3).first()
    mark = None if expected[0] is None else at(expected[0]).replace(tzinfo=None)
    assert (row.watermark_start_time, row.catching_up, row.succeeded) == (mark, *expected[1:3])
    assert (row.sync_error is not None, row.ingest_warning is not None) == expected[3:]


def test_a_failed_fetch_concerns_its_connection_only(spark):
    connections = rows.connections(
        spark,
        {"id": "bad", "watermark_start_time": NOW, "last_success_at": ago(hours=1), "catching_up": True},
        {"id": "good", "last_sync_error": "earlier", "last_ingest_warning": "lost some"},
        {"id": "off", "enabled": False, "last_sync_error": "stays"},
    )
    plan = ingest.fetch_plan(connections, timedelta(minutes=15))
    stats = spark.createDataFrame([("good", 1, 0, NOW)], "connection_id string, rows_returned long, unreadable long, newest timestamp")
    errors = spark.createDataFrame([("bad", "no route")], "connection_id string, fetch_error string")
    state = {
        row.id: row
        for row in ingest.apply_sync_state(connections, ingest.sync_outcome(plan, stats, 5, errors), timestamp(NOW)).collect()
    }
    naive = NOW.replace(tzinfo=None)
    assert (state["bad"].last_sync_error, state["bad"].watermark_start_time, state["bad"].catching_up) == ("no route", naive, True)
    assert state["bad"].last_success_at == naive - timedelta(hours=1)
    good = state["good"]
    assert (good.last_sync_error, good.last_success_at, good.last_ingest_warning) == (None, naive, "lost some")
    assert state["off"].last_sync_error == "stays" and state["off"].last_synced_at is None


def test_storage_schedule(spark):
    connections = rows.connections(
        spark,
        {"id": "never"},
        {"id": "due", "storage_attempted_at": ago(hours=1)},
        {"id": "recent", "storage_attempted_at": ago(minutes=59)},
        {"id": "off", "enabled": False},
    )
    due = ingest.storage_due(connections, timestamp(NOW), timedelta(hours=1))
    assert sorted(row[0] for row in due.collect()) == ["due", "never"]
    marked = ingest.mark_storage_attempt(connections, due, timestamp(NOW))
    assert ingest.storage_due(marked, timestamp(NOW), timedelta(hours=1)).count() == 0


def test_passes_drain_a_history(spark):
    root = scratch_dir(spark, "root")
    tables = Tables(spark, root, 24)
    tables.record_connections(rows.connections(spark, {}, {"id": "d"}), 0)
    history = rows.history(
        spark,
        *[{"start_ms": MS + 1000 * n, "query_text": f"select {n}"} for n in range(7)],
        {"query_id": "broken", "start_ms": MS + 500},
        {"connection_id": "d", "start_ms": MS},
    )
    settings = ingest.IngestSettings(batch_limit=4)
    for number in range(1, 5):
        ingest.ingest_pass(tables, history, number, scratch_dir(spark, "page"), timestamp(NOW), settings)
    assert tables.events().count() == 8
    assert tables.shapes().count() == 2
    state = {row.id: row for row in tables.connections().collect()}
    assert state["c"].watermark_start_time == (NOW + timedelta(seconds=6)).replace(tzinfo=None)
    assert state["c"].last_ingest_warning and state["c"].last_sync_error is None
    assert not state["d"].catching_up


# Health ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "changes, state, tone",
    [
        (dict(enabled=False, last_sync_error="x"), "disabled", "neutral"),
        (dict(last_sync_error="x", last_success_at=NOW), "failing", "danger"),
        (dict(), "pending", "neutral"),
        (dict(last_synced_at=NOW), "stale", "warn"),
        (dict(last_success_at=ago(seconds=301)), "stale", "warn"),
        (dict(last_success_at=ago(seconds=300)), "healthy", "ok"),
        (dict(last_success_at=NOW + timedelta(minutes=1), last_ingest_warning="lost"), "healthy", "warn"),
    ],
)
def test_health(spark, changes, state, tone):
    limit = health.stale_after(timedelta(seconds=10))
    row = health.ingestion_health(rows.connections(spark, changes), timestamp(NOW), limit).first()
    assert (row.health, row.tone, row.stale_after_seconds) == (state, tone, 300)
    assert row.seconds_since_success is None or row.seconds_since_success >= 0
    assert row.seconds_behind is None


def test_enabled_connections_come_oldest_first(spark):
    connections = rows.connections(
        spark, {"id": "b"}, {"id": "a", "created_at": ago(days=99)}, {"id": "x", "enabled": False}
    )
    assert [row.id for row in health.enabled_connections(connections).collect()] == ["a", "b"]


# Streams -----------------------------------------------------------------------------------------------------------------


def test_a_stream_ends_where_the_batch_ends(spark):
    history = rows.history(
        spark,
        *[
            {"query_id": str(uuid.UUID(int=n % 30)), "start_ms": MS - 60_000 * (n % 30), "query_text": f"select {n}", "execution_time_ms": n}
            for n in range(60)
        ],
        {"query_id": "broken"},
    )
    folder = scratch_dir(spark, "history")
    batches = [history.where(F.col("execution_time_ms").isNull() | (F.col("execution_time_ms") < 30)), history.where("execution_time_ms >= 30")]
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(folder)
    tables, work = Tables(spark, scratch_dir(spark, "tables"), 24), scratch_dir(spark, "work")
    stream = live.stream_upsert(
        spark.readStream.schema(source.HISTORY).option("maxFilesPerTrigger", 1).parquet(folder),
        tables,
        work,
        scratch_dir(spark, "progress"),
        now=NOW,
    )
    stream.awaitTermination()
    found = tables.events().collect()
    assert len(found) == 30 and {row.execution_time_ms for row in found} == set(range(30, 60))
    assert len({row.query_text for row in found} & {f"select {n}" for n in range(30)}) == 30, "the first text stays"
    assert tables.shapes().count() == 1 and len({row.fingerprint for row in found}) == 1
    assert spark.read.parquet(f"{work}/quarantine").count() == 1
    assert set(LAYOUT) < set(tables.events().columns)


def test_live_latency_matches_the_batch_counts(spark):
    history = rows.history(
        spark,
        *[{"query_id": str(uuid.UUID(int=n)), "start_ms": MS + 1000 * n, "total_elapsed_time_ms": n} for n in range(100)],
        {"start_ms": MS, "user_agent": "selfwatch", "query_id": str(uuid.UUID(int=999))},
    )
    folder, path = scratch_dir(spark, "history"), scratch_dir(spark, "live")
    # The newest first, the oldest a day late, and the middle delivered twice.
    for low, high in ((50, 101), (40, 60), (0, 50)):
        history.where((F.col("start_ms") >= MS + 1000 * low) & (F.col("start_ms") < MS + 1000 * high)).write.mode("append").parquet(folder)
    stream = live.stream_latency(
        spark.readStream.schema(source.HISTORY).option("maxFilesPerTrigger", 1).parquet(folder), path, scratch_dir(spark, "progress")
    )
    stream.awaitTermination()
    compacted = scratch_dir(spark, "compacted")
    live.compact_live(spark, path, compacted)
    for where in (path, compacted):
        first, second = live.live_latency(spark, where, "1 minute").orderBy("window_start").collect()
        assert (first.query_count, first.p50_ms) == (60, 29.5)
        assert (second.query_count, second.p50_ms) == (40, 79.5)


@pytest.mark.parametrize("numbered", [True, False])
def test_live_latency_takes_back_what_changes(spark, numbered):
    def delivered(*changes):
        base = {"start_ms": MS, "total_elapsed_time_ms": 10, "end_ms": MS + 5}
        return rows.history(spark, *[{**base, **change} for change in changes])

    ids = [str(uuid.UUID(int=n)) for n in range(6)]
    folder, path = scratch_dir(spark, "history"), scratch_dir(spark, "live")
    first = [{"query_id": i} for i in ids]
    second = [
        {"query_id": ids[0], "user_agent": "selfwatch"},  # own traffic after all
        {"query_id": ids[1], "total_elapsed_time_ms": 70},  # another duration
        {"query_id": ids[2], "error_type": "E"},  # failed after all
        {"query_id": ids[3], "start_ms": MS + 3_600_000},  # a moved start
        {"query_id": ids[4], "total_elapsed_time_ms": None},  # nothing measured
    ]
    third = [{"query_id": ids[0]}, {"query_id": ids[5]}]  # no own traffic in the end; a repeat
    for part in (first, second, third):
        delivered(*part).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(source.HISTORY).option("maxFilesPerTrigger", 1).parquet(folder)
    live.stream_latency(source.stream_history(spark, folder, 1) if numbered else stream, path, scratch_dir(spark, "progress")).awaitTermination()
    (row,) = live.live_latency(spark, path, "1 minute").collect()
    assert (row.query_count, row.failure_count, row.p50_ms) == (6, 1, 10.0)
    steps = spark.read.parquet(path)
    assert steps.where("runs < 0").count() and steps.agg(F.sum("runs")).first()[0] == 6


def test_late_agents_of_one_micro_batch_are_kept(spark):
    """Each run is delivered twice, the second time as own traffic; both are read at once."""
    ids = [{"query_id": str(uuid.UUID(int=n)), "start_ms": MS + n, "end_ms": MS + 9, "total_elapsed_time_ms": 9} for n in range(8)]
    folder = scratch_dir(spark, "history")
    rows.history(spark, *ids).coalesce(1).write.parquet(folder)
    rows.history(spark, *[{**i, "user_agent": "selfwatch"} for i in ids]).coalesce(1).write.mode("append").parquet(folder)
    tables, path = Tables(spark, scratch_dir(spark, "tables"), 24), scratch_dir(spark, "live")
    live.stream_upsert(source.stream_history(spark, folder), tables, scratch_dir(spark, "work"), scratch_dir(spark, "p"), now=NOW).awaitTermination()
    assert [(r.is_internal, r.user_agent) for r in tables.events().collect()] == [(True, "selfwatch")] * 8
    live.stream_latency(source.stream_history(spark, folder), path, scratch_dir(spark, "p")).awaitTermination()
    assert live.live_latency(spark, path).count() == 0


def test_a_stream_keeps_the_books(spark):
    folder, tables = scratch_dir(spark, "history"), Tables(spark, scratch_dir(spark, "tables"), 24)
    tables.record_connections(rows.connections(spark, {}, {"id": "d", "watermark_start_time": NOW, "catching_up": True}, {"id": "quiet"}), 0)
    for n in range(3):
        at = [{"query_id": str(uuid.UUID(int=10 * n + k)), "start_ms": MS + 1000 * n + k} for k in range(4)]
        stuck = [{"query_id": str(uuid.UUID(int=k)), "start_ms": MS, "connection_id": "d"} for k in range(4)]
        bad = [{"query_id": "broken"}] if n == 1 else []
        rows.history(spark, *at, *stuck, *bad).coalesce(1).write.mode("append").parquet(folder)
    settings = ingest.IngestSettings(batch_limit=4, compact_after=2)
    live.stream_upsert(
        source.stream_history(spark, folder, 1), tables, scratch_dir(spark, "work"), scratch_dir(spark, "p"), now=NOW, settings=settings
    ).awaitTermination()
    state = {row.id: row for row in tables.connections().collect()}
    naive = NOW.replace(tzinfo=None)
    assert state["c"].watermark_start_time == naive + timedelta(milliseconds=2003) and state["c"].catching_up
    assert state["c"].last_ingest_warning.startswith("1 unreadable") and state["c"].last_sync_error is None
    assert "raise the batch limit" in state["d"].last_sync_error and state["d"].watermark_start_time == naive
    assert state["quiet"].last_synced_at is None
    assert tables.events().count() == 16 and len(tables.pending_batches()) < 2


def test_live_latency_of_many_batches_is_kept_without_python_in_few_folders(spark, monkeypatch):
    import glob

    monkeypatch.setattr(live, "KEPT_BATCHES", 2)
    folder, path, progress = scratch_dir(spark, "history"), scratch_dir(spark, "live"), scratch_dir(spark, "progress")
    for n in range(6):
        again = [{"query_id": str(uuid.UUID(int=k)), "start_ms": MS + n, "total_elapsed_time_ms": 10 * n + k} for k in range(n + 1)]
        rows.history(spark, *again).coalesce(1).write.mode("append").parquet(folder)
    live.stream_latency(source.stream_history(spark, folder, 1), path, progress).awaitTermination()
    (row,) = live.live_latency(spark, path, "1 minute").collect()
    assert (row.query_count, row.p50_ms) == (6, 52.5)
    assert len(glob.glob(f"{progress}/runs/*=*")) < 4 and not glob.glob(f"{progress}/state/*")


def test_a_long_page_is_not_ranked_in_one_task(spark):
    """Only the minute in which a page ends is ranked, whatever the page holds."""
    history = rows.history(spark, *[{"start_ms": MS + 15_000 * n} for n in range(400)])
    plan = spark.createDataFrame([("c", None)], "connection_id string, since timestamp")
    due = source._due(history.select("connection_id", "start_ms", "query_id"), plan)
    assert source._page_ends(due, 302).first()._last == (MS + 15_000 * 301, str(uuid.UUID(int=302)))
    assert source.history_page(history, plan, 302).count() == 302
    assert source.history_page(history, plan, 1000).count() == 400


def test_slots_are_moved_into_place_as_written(spark):
    import glob

    tables = Tables(spark, scratch_dir(spark, "tables"), 24)
    written, publish = [], Tables._publish

    class Seen(Tables):
        def _publish(self, placed, path):
            publish(self, placed, path)
            if path != self._events:
                written.extend(name.rsplit("/", 1)[-1] for name in glob.glob(f"{path}/*/*/*.parquet"))

    Seen(spark, root_of(tables), 24).upsert_events(runs(spark, range(30)))
    kept = {name.rsplit("/", 1)[-1] for name in glob.glob(f"{tables._events}/*/*/*.parquet")}
    assert kept and kept == set(written)
