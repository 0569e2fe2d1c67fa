"""The same ingest and the same latency read on streams."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runledger.operators.merge import SEQ
from runledger.operators.quantiles import summarize
from runledger.plans.ingest import (
    IngestSettings,
    apply_sync_state,
    batch_stats,
    fetch_plan,
    staged,
    store_batch,
    sync_outcome,
)
from runledger.plans.params import timestamp
from runledger.sources.history import internal_traffic, readable_rows, unreadable_rows
from runledger.sources.tables import Tables, delete, listed


def stream_upsert(
    history: DataFrame,
    tables: Tables,
    work: str,
    checkpoint: str,
    now: datetime | None = None,
    every: str | None = None,
    settings: IngestSettings = IngestSettings(),
    writer: str = "stream",
) -> StreamingQuery:
    """Ingests a stream of history rows into the tables and keeps the books of its connections.

    Every fetched row is stored however late it is; keyed merges make a repeated micro-batch harmless. ``seq`` orders the
    deliveries of a run (``delivery_number`` makes it where the source has none). Unreadable rows go to
    ``work/quarantine``, one folder per batch so that a repeat replaces it. With ``every`` the stream polls at that
    interval, without it drains what is there and stops.

    The state of a connection (watermark, catching up, error, warning) is carried from micro-batch to micro-batch in the
    connections table and written last, from the state the batch before it left, so a repeated batch counts once. A batch
    in which a connection has no rows leaves its state alone.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        at = F.current_timestamp() if now is None else timestamp(now)
        # A stream's own session plans without adaptive execution; what follows is planned in the tables'.
        page = staged(batch, f"{work}/page", tables.spark)
        unreadable_rows(page).write.mode("overwrite").parquet(f"{work}/quarantine/batch={batch_id}")
        store_batch(tables, readable_rows(page), f"{work}/staging", at, writer, batch_id)
        tables.compact(settings.compact_after)
        stats = staged(batch_stats(page), f"{work}/stats")
        tables.advance_connections(lambda before: after_batch(before, stats, settings, at), writer, batch_id)

    query = history.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (query.trigger(processingTime=every) if every else query.trigger(availableNow=True)).start()


def after_batch(connections: DataFrame, stats: DataFrame, settings: IngestSettings, now: Column) -> DataFrame:
    """The state of the connections after a micro-batch with these ``batch_stats``."""
    fetched = connections.join(stats.select(F.col("connection_id").alias("id")), "id", "left_semi")
    outcome = sync_outcome(fetch_plan(fetched, settings.overlap), stats, settings.batch_limit)
    return apply_sync_state(connections, outcome, now)


_RUN = ["connection_id", "query_id"]
# What is kept of a run: where it starts, and what it adds to the histograms.
_VALUE = ["elapsed", "failed", "is_internal"]
_KNOWN = "connection_id string, query_id string, start_us long, elapsed long, failed boolean, is_internal boolean, reached string"
_OLD = "struct<start_us: bigint, elapsed: bigint, failed: boolean, is_internal: boolean, reached: string>"
_CHANGES = f"{_KNOWN}, old {_OLD}"
_CELLS = "connection_id string, cell_start timestamp, total_elapsed_time_ms long, runs long, failures long"
# Batches whose runs are kept apart before they are merged into one folder.
KEPT_BATCHES = 16


def _known(spark: SparkSession, folder: str, batch_id: int) -> DataFrame | None:
    """The runs as the batches before ``batch_id`` left them, None before the first. A run is in the folder of each batch
    that read it, and the last of these counts; of many batches the folders are merged into one first."""

    def numbers(kind: str) -> list[int]:
        done = [path.split(f"/{kind}=")[-1] for path in listed(spark, f"{folder}/{kind}=*/_SUCCESS")]
        return sorted(number for number in (int(rest.split("/")[0]) for rest in done) if number < batch_id)

    def latest(upto: int | None, batches: list[int]) -> DataFrame:
        parts = [(upto, f"{folder}/upto={upto}")] if upto is not None else []
        parts += [(number, f"{folder}/batch={number}") for number in batches]
        read = [spark.read.schema(_KNOWN).parquet(path).withColumn("_batch", F.lit(number)) for number, path in parts]
        if len(read) == 1:
            return read[0].drop("_batch")
        state = F.struct("start_us", *_VALUE, "reached")
        return reduce(DataFrame.unionByName, read).groupBy(*_RUN).agg(F.max_by(state, "_batch").alias("run")).select(*_RUN, "run.*")

    upto = max(numbers("upto"), default=None)
    batches = [number for number in numbers("batch") if upto is None or number > upto]
    if not batches and upto is None:
        return None
    if len(batches) >= KEPT_BATCHES:
        latest(upto, batches).write.mode("overwrite").parquet(f"{folder}/upto={batches[-1]}")
        for path in [f"{folder}/batch={number}" for number in batches] + ([] if upto is None else [f"{folder}/upto={upto}"]):
            delete(spark, path)
        upto, batches = batches[-1], []
    return latest(upto, batches)


def _changes(runs: DataFrame, known: DataFrame | None, numbered: bool) -> DataFrame:
    """Each run that a micro-batch read, as it is now and, in ``old``, as it was before. A run read before its last delivery
    is left out where deliveries are numbered."""
    value = F.struct("reached", *_VALUE)
    new = runs.groupBy(*_RUN).agg(
        F.min_by("start_us", F.struct("reached", "start_us")).alias("start_us"), F.max(value).alias("last")
    ).select(*_RUN, "start_us", "last.*")
    if known is None:
        return new.select(*_RUN, "start_us", *_VALUE, "reached", F.lit(None).cast(_OLD).alias("old"))
    before = known.select(*[F.col(name).alias(f"_{name}") for name in _RUN], F.struct("start_us", *_VALUE, "reached").alias("old"))
    joined = new.join(before, F.expr(" and ".join(f"{name} <=> _{name}" for name in _RUN)), "left")
    if numbered:
        joined = joined.where("old is null or reached >= old.reached")
    return joined.select(*_RUN, F.coalesce("old.start_us", "start_us").alias("start_us"), *_VALUE, "reached", "old")


def _steps(changes: DataFrame) -> DataFrame:
    """What a micro-batch changes: a run's old value out, its new one in. Own traffic counts nowhere."""
    same = " and ".join(f"{name} <=> old.{name}" for name in _VALUE)
    sides = F.array(
        F.struct(F.lit(-1).cast("long").alias("runs"), F.col("old.start_us").alias("start_us"), *[F.col(f"old.{name}").alias(name) for name in _VALUE]),
        F.struct(F.lit(1).cast("long").alias("runs"), "start_us", *_VALUE),
    )
    signed = changes.where(f"old is null or not ({same})").select("connection_id", F.inline(sides)).where("start_us is not null and not is_internal")
    failures = F.col("runs") * F.col("failed").cast("long")
    return signed.select("connection_id", "start_us", F.col("elapsed").alias("total_elapsed_time_ms"), "runs", failures.alias("failures"))


def stream_latency(
    history: DataFrame,
    path: str,
    checkpoint: str,
    every: str | None = None,
    cell: str = "1 minute",
) -> StreamingQuery:
    """Keeps histograms of the durations of runs per connection and ``cell`` of time for :func:`live_latency`.

    The latest known of each run is kept in ``checkpoint/runs``, a narrow row each. A delivery that changes a run's duration,
    its outcome or whether it is own traffic writes two steps: the old value out of its cell, the new one in. So a run counts
    once whatever is delivered again, and own traffic that is recognised late leaves the figures. A run stays where it was
    first said to start. A delivery counts as later by ``seq``; without it, if it was read in a later micro-batch, and within
    one, by how far the run had come. Nothing is lost to a watermark. A read adds up steps, not deliveries, and
    :func:`compact_live` adds up those of many batches.

    Runs are folded, joined with what is known of them and summed as columns, so no run costs a call to Python. A batch that
    is repeated starts from what the batches before it left and replaces its folders.
    """
    numbered = SEQ in history.columns
    drafts = readable_rows(history)
    order = F.col(SEQ).cast("string") if numbered else F.lpad(F.coalesce(F.unix_millis("end_time") + 1, F.lit(0)).cast("string"), 20, "0")
    runs = drafts.select(
        *_RUN,
        F.unix_micros("start_time").alias("start_us"),
        F.col("total_elapsed_time_ms").alias("elapsed"),
        F.col("error_type").isNotNull().alias("failed"),
        internal_traffic().alias("is_internal"),
        order.alias("reached"),
    )
    kept = f"{checkpoint}/runs"

    def store(batch: DataFrame, batch_id: int) -> None:
        spark, folder = batch.sparkSession, f"{kept}/batch={batch_id}"
        _changes(batch, _known(spark, kept, batch_id), numbered).write.mode("overwrite").parquet(folder)
        steps = _steps(spark.read.schema(_CHANGES).parquet(folder))
        placed = steps.withColumn("cell_start", F.window(F.timestamp_micros("start_us"), cell)["start"])
        _summed(placed).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = runs.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (query.trigger(processingTime=every) if every else query.trigger(availableNow=True)).start()


def _summed(steps: DataFrame) -> DataFrame:
    cell = ["connection_id", "cell_start", "total_elapsed_time_ms"]
    summed = steps.groupBy(*cell).agg(F.sum("runs").alias("runs"), F.sum("failures").alias("failures"))
    return summed.where("runs <> 0 or failures <> 0")


def compact_live(spark: SparkSession, path: str, into: str) -> None:
    """Writes the histograms as one batch below ``into``, a new folder for the stream to go on with."""
    _summed(spark.read.schema(_CELLS).parquet(path)).write.mode("overwrite").parquet(f"{into}/batch=0")


def live_latency(spark: SparkSession, path: str, width: str = "5 minutes") -> DataFrame:
    """Counts and exact percentiles per connection and tumbling window, a whole number of the stream's cells wide."""
    cells = spark.read.schema(_CELLS).parquet(path)
    window = F.window("cell_start", width)["start"]
    placed = cells.select("connection_id", window.alias("cell_start"), "total_elapsed_time_ms", "runs", "failures")
    counted = _summed(placed).withColumnRenamed("cell_start", "window_start")
    return summarize(
        counted,
        ["connection_id", "window_start"],
        "total_elapsed_time_ms",
        {"p50_ms": 0.5, "p95_ms": 0.95},
        {"query_count": F.sum("runs"), "failure_count": F.sum("failures")},
        weight="runs",
    )
