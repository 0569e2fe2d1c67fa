"""The stored tables, as parquet under one root folder.

Events are laid out by time slot, which bounds what a read or a rewrite touches. Slots hold all connections, sorted, so that
a small connection does not mean small files; parquet's statistics skip the rows of the others.

A batch is not merged into its slots when it comes. It is appended as a folder of *deltas*, one folded row for each key, in
the slot where the key is stored: ``keys`` says where that is, whatever start the batch reports, so a run whose start moves
stays one row. Reading folds the deltas into the rows of their slots; :meth:`Tables.compact` does it for good. Writers only
ever add folders of their own (writer and batch), and a batch that is repeated replaces its folder, so any number may append
at a time. Slots are rewritten by one process at a time: ``compact``, ``replace_slots``, ``purge``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from runledger.operators.cells import LAYOUT, cells_of, histogram_of
from runledger.operators.merge import EVENT_KEY, SEQ, fold_deliveries, folded_into, one_per_key, purge
from runledger.operators.shapes import backfill_flags, new_shapes, pending_flags
from runledger.operators.storage import new_samples
from runledger.schema import CONNECTIONS, EVENTS, SHAPES, STORAGE

_SLOT = [StructField("start_date", DateType(), False), StructField("start_slot", IntegerType(), False)]
_BATCH = [StructField("writer", StringType(), False), StructField("batch", LongType(), False)]
_FILES = StructType(EVENTS.fields + _SLOT)
_DELTAS = StructType([*EVENTS.fields, StructField("delivered", TimestampType(), False), *_BATCH, *_SLOT])
_KEY = [EVENTS[name] for name in EVENT_KEY]
_RECENT = StructType([*_KEY, *_SLOT, *_BATCH])
_SETTLED = StructType([*_KEY, *_SLOT, StructField("bucket", IntegerType(), False)])
_STATES = StructType([*CONNECTIONS.fields, StructField("recorded_by", StringType(), True)])
# States of the connections that stay: the latest, and the one that a repeated batch starts from.
KEPT_STATES = 2


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _path(spark, path)
    return files.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    target, files = _path(spark, path)
    files.delete(target, True)


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match; folder names only, so a list is as long as there are folders."""
    target, files = _path(spark, pattern)
    found = files.globStatus(target)
    return [] if found is None else sorted(status.getPath().toString() for status in found)


def _empty(spark: SparkSession, schema: StructType) -> DataFrame:
    """No rows, which Spark sees while it plans, so that joins with them go."""
    columns = [F.lit(None).cast(field.dataType).alias(field.name) for field in schema.fields]
    return spark.range(0).where(F.lit(False)).select(*columns)


def _value(path: str, name: str) -> str:
    return next(part.split("=", 1)[1] for part in path.split("/") if part.startswith(f"{name}="))


class Tables:
    """``slot_hours`` is fixed when the event table is created: 1 for a busy history, up to 24 for a quiet one.
    ``key_buckets`` is the number of hash folders of the keys, fixed with the first compaction."""

    def __init__(self, spark: SparkSession, root: str, slot_hours: int = 1, key_buckets: int = 16) -> None:
        if slot_hours not in (1, 2, 3, 4, 6, 8, 12, 24):
            raise ValueError("slot_hours must divide a day")
        self.spark = spark
        self.slot_hours = slot_hours
        self.key_buckets = key_buckets
        self._events, self._shapes, self._storage, self._connections, self._pending, self._deltas, self._keys, self._done = (
            f"{root}/{name}" for name in ("events", "shapes", "storage", "connections", "pending", "deltas", "keys", "done")
        )
        self._cells, self._histogram = f"{root}/cells", f"{root}/histogram"
        self._incoming = f"{root}/incoming"
        self._recent, self._settled = f"{self._keys}/recent", f"{self._keys}/settled"

    def _read(self, path: str, schema: StructType) -> DataFrame:
        if not exists(self.spark, path):
            # A replacement may have been cut short between taking the old table away and putting the new one there.
            path = f"{path}-new"
            if not exists(self.spark, f"{path}/_SUCCESS"):
                return _empty(self.spark, schema)
        return self.spark.read.schema(schema).parquet(path)

    def stored_events(self) -> DataFrame:
        """The slots as they were last compacted, with the layout columns, which event filters use to skip folders."""
        return self._read(self._events, _FILES)

    def events(self) -> DataFrame:
        """All events, deltas folded in. Slots without deltas are read as they are; the others are joined with theirs, and
        filters reach both sides."""
        stored, slots = self.stored_events(), self._delta_slots()
        if not slots:
            return stored
        held = _in_slots(slots)
        return stored.where(~held).unionByName(self._with_deltas(stored.where(held), self._folded(self._read(self._deltas, _DELTAS))))

    def _with_deltas(self, stored: DataFrame, deltas: DataFrame) -> DataFrame:
        both = [*EVENT_KEY, *LAYOUT]
        fresh = deltas.join(stored.select(*both), both, "left_anti").select(*_FILES.names)
        return folded_into(stored, deltas, LAYOUT).unionByName(fresh)

    def _folded(self, deltas: DataFrame) -> DataFrame:
        order = deltas.withColumn("_order", F.struct("delivered", "writer", "batch"))
        return fold_deliveries(order, "_order", LAYOUT)

    def _delta_slots(self) -> set[tuple[date, int]]:
        folders = listed(self.spark, f"{self._deltas}/writer=*/batch=*/start_date=*/start_slot=*")
        return {(date.fromisoformat(_value(path, "start_date")), int(_value(path, "start_slot"))) for path in folders}

    def shapes(self) -> DataFrame:
        return self._read(self._shapes, SHAPES)

    def storage(self) -> DataFrame:
        return self._read(self._storage, STORAGE)

    def _states(self) -> list[int]:
        return sorted(int(_value(path, "pass")) for path in listed(self.spark, f"{self._connections}/pass=*/_SUCCESS"))

    def _state(self, number: int) -> DataFrame:
        return self.spark.read.schema(_STATES).parquet(f"{self._connections}/pass={number}")

    def connections(self) -> DataFrame:
        """As left by the latest pass."""
        states = self._states()
        return self._state(states[-1]).drop("recorded_by") if states else self.spark.createDataFrame([], CONNECTIONS)

    def placed(self, rows: DataFrame) -> DataFrame:
        slot = F.hour("start_time") - F.hour("start_time") % self.slot_hours
        return rows.withColumn("start_date", F.to_date("start_time")).withColumn("start_slot", slot)

    # Slots ---------------------------------------------------------------------------------------------------------------

    def replace_slots(self, events: DataFrame) -> None:
        """Replaces the slots present in ``events``, which may name them in the layout columns, and no others. The rebalance
        splits a busy slot over many tasks and joins quiet ones, so files come out near the advisory size either way.

        Replacing a slot deletes its folder before the new one takes its place. The new rows are therefore complete in a
        folder of their own first, from where slots are moved; should the driver die in between, ``recover`` moves the rest.
        """
        self.recover()
        rows = events.select(*_FILES.names) if set(LAYOUT) <= set(events.columns) else self.placed(events.select(*EVENTS.names))
        pending = f"{self._pending}/{uuid.uuid4().hex}"
        self._publish(rows, pending)
        self._finish(pending)

    def _publish(self, placed: DataFrame | str, path: str) -> None:
        """Writes rows aside by slots, or puts the slots of a folder so written in the place of those at ``path``."""
        if isinstance(placed, str):
            for folder in listed(self.spark, f"{placed}/start_date=*/start_slot=*"):
                self._move(folder, f"{path}/start_date={_value(folder, 'start_date')}/start_slot={_value(folder, 'start_slot')}")
            return
        (
            placed.hint("rebalance", *[F.col(name) for name in LAYOUT])
            .sortWithinPartitions(*LAYOUT, "connection_id", "start_time")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            # For a look-up by a literal id, which skips the row groups that do not hold it.
            .option("parquet.bloom.filter.enabled#query_id", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .partitionBy(*LAYOUT)
            .parquet(path)
        )

    def _move(self, source: str, path: str) -> None:
        delete(self.spark, path)
        (origin, files), (target, _) = _path(self.spark, source), _path(self.spark, path)
        files.mkdirs(target.getParent())
        if not files.rename(origin, target):
            raise OSError(f"{source} could not take the place of {path}")

    def _finish(self, pending: str) -> None:
        """Sums first, while all slots are still in ``pending``: if slots have been moved, their sums are written."""
        rows = self.spark.read.schema(_FILES).parquet(pending)
        for summed, path in ((cells_of(rows), self._cells), (histogram_of(rows), self._histogram)):
            (
                summed.hint("rebalance", *[F.col(name) for name in LAYOUT])
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(*LAYOUT)
                .parquet(path)
            )
        self._publish(pending, self._events)
        delete(self.spark, pending)

    def cells(self) -> DataFrame:
        """Sums of the slots, rewritten with them; of slots with deltas they are taken from the events."""
        return self._sums(self._cells, cells_of)

    def histogram(self) -> DataFrame:
        """Durations of the runs of the slots, likewise."""
        return self._sums(self._histogram, histogram_of)

    def _sums(self, path: str, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
        schema = of(self.spark.createDataFrame([], _FILES)).schema
        stored, slots = self._read(path, schema).select(*schema.names), self._delta_slots()
        if not slots:
            return stored
        held = _in_slots(slots)
        return stored.where(~held).unionByName(of(self.events().where(held)))

    def recover(self) -> None:
        """Completes what was cut short; without anything it does nothing. Every rewrite starts with this, and doing it again
        replaces slots with the same rows. A folder that is itself incomplete is not used: nothing had been touched when it
        was written."""
        for marker in listed(self.spark, f"{self._pending}/*/_SUCCESS"):
            self._finish(marker.rsplit("/", 1)[0])
        for path in (self._shapes, self._storage, self._settled):
            if exists(self.spark, f"{path}-new/_SUCCESS"):
                self._swap(path)

    def slots_of(self, rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
        """Stored events of the slots that ``rows`` fall in, or lie in if they name them. There are at most 24 slots a day, so
        their list is broadcast whatever ``rows`` holds; being the layout, it prunes the other folders when the scan starts.
        Spark prunes by lists that carry a comparison only, hence the one that is always true."""
        placed = rows if set(LAYOUT) <= set(rows.columns) else self.placed(rows.select("start_time"))
        slots = placed.select(*LAYOUT).where("start_date >= date'0001-01-01'").distinct()
        return (self.events() if stored is None else stored).join(F.broadcast(slots), LAYOUT, "left_semi")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The stored events of some keys (connection_id, query_id): their slots are looked up first, and no other slot is
        read."""
        homes = self.homes(keys)
        slots = homes.where("start_date >= date'0001-01-01'").select(*LAYOUT).distinct()
        near = self.events().join(F.broadcast(slots), LAYOUT, "left_semi")
        return near.join(homes, [*EVENT_KEY, *LAYOUT], "left_semi")

    # Deltas --------------------------------------------------------------------------------------------------------------

    def homes(self, keys: DataFrame, writer: str | None = None, batch: int | None = None) -> DataFrame:
        """Where the given keys (connection_id, query_id) are stored, with the layout columns; keys not stored are left out.
        What the given batch itself wrote earlier does not count.

        Settled keys lie in hash folders, and the folders that none of the keys fall in are not read."""
        recent = self._read(self._recent, _RECENT)
        if writer is not None:
            recent = recent.where((F.col("writer") != writer) | (F.col("batch") != batch))
        wanted = keys.select(*EVENT_KEY).distinct().withColumn("bucket", self._bucket())
        # At most as many as there are folders; the comparison lets Spark prune by them.
        buckets = wanted.select("bucket").where("bucket >= 0").distinct()
        near = self._read(self._settled, _SETTLED).join(F.broadcast(buckets), "bucket", "left_semi")
        settled = near.join(wanted, ["bucket", *EVENT_KEY], "left_semi")
        found = settled.select(*EVENT_KEY, *LAYOUT).unionByName(
            recent.join(wanted, EVENT_KEY, "left_semi").select(*EVENT_KEY, *LAYOUT)
        )
        # A batch that was settled twice lists its keys twice.
        return found.groupBy(*EVENT_KEY).agg(F.min(F.struct(*LAYOUT)).alias("home")).select(*EVENT_KEY, "home.*")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*EVENT_KEY), F.lit(self.key_buckets)).cast("int")

    def settled_upto(self, writer: str) -> int:
        """The last batch of a writer that has gone into the slots."""
        return max((int(_value(path, "upto")) for path in listed(self.spark, f"{self._done}/writer={writer}/upto=*")), default=-1)

    def append_events(self, events: DataFrame, writer: str, batch: int) -> None:
        """Adds a batch of deliveries. Batches of a writer are numbered upwards; repeating one replaces it, keeping its place
        among the others, and repeating one that has been compacted does nothing.

        A batch may repeat keys and carry ``seq``, the order of delivery. It is folded to one row a key, and only these rows
        and the keys are written, whatever the slots hold.
        """
        if batch <= self.settled_upto(writer):
            return
        folder = f"{self._deltas}/writer={writer}/batch={batch}"
        delivered = F.current_timestamp()
        if exists(self.spark, f"{folder}/_SUCCESS"):
            before = self.spark.read.schema(StructType([_DELTAS["delivered"]])).parquet(folder).agg(F.min("delivered")).first()[0]
            delivered = delivered if before is None else F.lit(before)
        folded = self.placed(one_per_key(events.select(*EVENTS.names, *[name for name in events.columns if name == SEQ])))
        # Folded once, for the look-up of homes and for the batch itself.
        incoming = f"{self._incoming}/writer={writer}/batch={batch}"
        folded.write.mode("overwrite").parquet(incoming)
        new = self.spark.read.schema(folded.schema).parquet(incoming)
        homes = self.homes(new, writer, batch).select(*EVENT_KEY, *[F.col(name).alias(f"_{name}") for name in LAYOUT])
        at_home = new.join(homes, EVENT_KEY, "left").select(
            *EVENTS.names, *[F.coalesce(f"_{name}", name).alias(name) for name in LAYOUT]
        )
        (
            at_home.withColumn("delivered", delivered)
            .hint("rebalance", *[F.col(name) for name in LAYOUT])
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .partitionBy(*LAYOUT)
            .parquet(folder)
        )
        keys = self.spark.read.schema(StructType([*_KEY, *_SLOT])).parquet(folder)
        keys.write.mode("overwrite").parquet(f"{self._recent}/writer={writer}/batch={batch}")
        delete(self.spark, incoming)

    def pending_batches(self) -> list[tuple[str, int]]:
        """Batches that are complete and not compacted."""
        done = listed(self.spark, f"{self._deltas}/writer=*/batch=*/_SUCCESS")
        return sorted((_value(path, "writer"), int(_value(path, "batch"))) for path in done)

    def compact(self, at_least: int = 1) -> None:
        """Merges the deltas into their slots, if there are ``at_least`` so many batches. Cut short anywhere, it can be done
        again: folding a delta twice changes nothing, and its folder goes last."""
        batches = self.pending_batches()
        if not batches or len(batches) < at_least:
            return
        folders = [f"{self._deltas}/writer={writer}/batch={batch}" for writer, batch in batches]
        deltas = self.spark.read.schema(_DELTAS).option("basePath", self._deltas).parquet(*folders)
        stored = self.stored_events().where(_in_slots(self._delta_slots()))
        self.replace_slots(self._with_deltas(stored, self._folded(deltas)))
        recent = [f"{self._recent}/writer={writer}/batch={batch}" for writer, batch in batches]
        keys = self.spark.read.schema(StructType([*_KEY, *_SLOT])).parquet(*[p for p in recent if exists(self.spark, p)])
        self._settle(keys)
        for writer, batch in batches:
            target, files = _path(self.spark, f"{self._done}/writer={writer}/upto={batch}")
            files.mkdirs(target)
        for path in (*folders, *recent):
            delete(self.spark, path)
        for writer in {writer for writer, _ in batches}:
            upto = self.settled_upto(writer)
            for path in listed(self.spark, f"{self._done}/writer={writer}/upto=*"):
                if int(_value(path, "upto")) < upto:
                    delete(self.spark, path)

    def _settle(self, keys: DataFrame, mode: str = "append") -> None:
        bucketed = keys.withColumn("bucket", self._bucket())
        bucketed.repartition(self.key_buckets, "bucket").write.mode(mode).partitionBy("bucket").parquet(self._settled)

    def load_events(self, events: DataFrame) -> None:
        """Fills an empty table: slots and keys, without deltas."""
        self.replace_slots(events)
        self._settle(self.stored_events().select(*EVENT_KEY, *LAYOUT))

    def upsert_events(self, batch: DataFrame, writer: str = "upsert") -> None:
        """Merges a batch at once: appended as the writer's next one and compacted with whatever else is pending."""
        numbers = [number for name, number in self.pending_batches() if name == writer]
        self.append_events(batch, writer, max([self.settled_upto(writer), *numbers]) + 1)
        self.compact()

    # Other tables --------------------------------------------------------------------------------------------------------

    def register_shapes(self, events: DataFrame) -> None:
        """Adds the shapes of ``events`` the table lacks. Only additions are written."""
        new_shapes(events, self.shapes()).write.mode("append").parquet(self._shapes)

    def backfill_flags(self) -> None:
        """Examines the stored shapes that have no flags yet."""
        shapes = self.shapes()
        if not exists(self.spark, self._shapes) or not shapes.where(F.col("antipatterns").isNull()).limit(1).count():
            return
        self._replace(backfill_flags(shapes, pending_flags(shapes)), self._shapes)

    def purge(self, connections: DataFrame) -> None:
        """Removes the given connections (id) and all that hangs off them, the connections themselves last. Only slots that
        hold one of them are rewritten."""
        self.recover()
        self.compact()
        gone = connections.select("id")
        owned = gone.select(F.col("id").alias("connection_id"))
        stored = self.stored_events()
        slots = stored.join(owned, "connection_id", "left_semi").select(*LAYOUT).distinct().persist()
        hit = {(row.start_date, row.start_slot) for row in slots.collect()}  # at most 24 a day
        if hit:
            left = purge(stored.where(_in_slots(hit)), connections)
            kept = {(row.start_date, row.start_slot) for row in left.select(*LAYOUT).distinct().collect()}
            if kept:
                self.replace_slots(left)
            for day, slot in hit - kept:
                for path in (self._events, self._cells, self._histogram):
                    delete(self.spark, f"{path}/start_date={day}/start_slot={slot}")
        slots.unpersist()
        for path, schema in ((self._shapes, SHAPES), (self._storage, STORAGE), (self._settled, _SETTLED)):
            if exists(self.spark, path):
                layout = ["bucket"] if path == self._settled else []
                self._replace(purge(self._read(path, schema), connections), path, *layout)
        states = self._states()
        if states:
            left = self._state(states[-1]).join(gone, "id", "left_anti")
            self._write_state(left, states[-1] + 1)

    def _replace(self, rows: DataFrame, path: str, *layout: str) -> None:
        """Rewrites a whole table from rows read from it: aside first, complete, then in its place. ``recover`` completes it,
        and reads find the new table where the old one is already gone."""
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
        (writer.partitionBy(*layout) if layout else writer).parquet(f"{path}-new")
        self._swap(path)

    def _swap(self, path: str) -> None:
        self._move(f"{path}-new", path)

    def append_storage(self, batch: DataFrame) -> None:
        """Adds the measurements the table lacks."""
        new_samples(self.storage(), batch).write.mode("append").parquet(self._storage)

    def _write_state(self, state: DataFrame, number: int) -> None:
        state.select(*_STATES.names).write.mode("overwrite").parquet(f"{self._connections}/pass={number}")
        for old in self._states()[:-KEPT_STATES]:
            delete(self.spark, f"{self._connections}/pass={old}")

    def record_connections(self, connections: DataFrame, pass_number: int) -> None:
        """Stores the state after a pass next to the one before, so that it can be built from it and a failed write loses
        nothing. Repeating a pass replaces its own state."""
        self._write_state(connections.select(*CONNECTIONS.names).withColumn("recorded_by", F.lit(None).cast("string")), pass_number)

    def advance_connections(self, change: Callable[[DataFrame], DataFrame], writer: str, batch: int) -> None:
        """Stores ``change`` of the state as the next one, marked with the batch that made it. A batch that is repeated starts
        again from the state it started from, so that it counts once."""
        states, mark = self._states(), f"{writer}/{batch}"
        if not states:
            return
        made_last = self._state(states[-1]).select("recorded_by").first()
        at = len(states) - 1
        if made_last is not None and made_last[0] == mark and at:
            at -= 1
        before = self._state(states[at]).drop("recorded_by")
        self._write_state(change(before).withColumn("recorded_by", F.lit(mark)), states[at] + 1)


def _in_slots(slots: Iterable[tuple[date, int]]) -> Column:
    """Of the layout columns only, so that folders are skipped by it."""
    names = [f"{day.isoformat()}/{slot}" for day, slot in sorted(slots)]
    return F.concat_ws("/", F.col("start_date").cast("string"), F.col("start_slot").cast("string")).isin(names)
