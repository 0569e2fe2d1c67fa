"""The registered queries: every operator over whole driver tables, all connections at once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, TimestampType

from checks import sample
from checks.sample import HALF, MONTH, NOW, everything
from runledger.functions import statements
from runledger.operators import cells, charts, findings, health, merge, reads, shapes, storage
from runledger.plans import ingest
from runledger.plans.params import ListOptions, TimeRange, timestamp
from runledger.session import scratch_dir, spread
from runledger.sources import history as source
from runledger.sources.tables import LAYOUT, Tables
from runledger.streaming import live

Query = Callable[[SparkSession, str], DataFrame]

MID = HALF.start
# Kept small so that the limit bites on every connection.
PAGE = 100
# Columns the list oracles leave out.
UNLISTED = ("fingerprint", *LAYOUT)
POLL = timedelta(hours=1)
# The connection that holds a third of the events.
HOT = "conn-8"
VIEW_SHAPE = "select v.a from views v,pages p where v.id in(?)"
WEEKS = TimeRange(datetime(2024, 1, 8), datetime(2024, 1, 29))


def plain(rows: DataFrame) -> DataFrame:
    """Results in types that compare across engines: zone-less times, doubles to six places, arrays as text.

    Costs are whole multiples of a small unit that often fall exactly between two sixth decimals; the nudge, smaller
    than the unit, makes both engines round those the same way.
    """

    def convert(name: str, kind) -> Column:
        column = F.col(name)
        if isinstance(kind, TimestampType):
            return column.cast("timestamp_ntz").alias(name)
        if isinstance(kind, DoubleType):
            return F.round(column + F.lit(1e-9), 6).alias(name)
        if isinstance(kind, ArrayType):
            return F.array_join(column, ",").alias(name)
        return column

    return rows.select(*[convert(field.name, field.dataType) for field in rows.schema.fields])


_REGISTRY: dict[str, Query] = {}


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(build(spark, sf_dir))

    _REGISTRY[build.__name__] = run
    return build


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


# Sources and sinks ---------------------------------------------------------------------------------------------------


def _page(spark: SparkSession, d: str) -> DataFrame:
    plan = ingest.fetch_plan(sample.connections(spark, d), ingest.IngestSettings().overlap)
    return source.history_page(sample.history(spark, d), plan, PAGE)


@query
def history_page(spark, d):
    return _page(spark, d).select("connection_id", "query_id", "start_ms", "query_text", "execution_time_ms")


@query
def history_drained(spark, d):
    """Every due row of every connection, page by page, with connections whose rows share one instant."""
    plan = ingest.fetch_plan(sample.connections(spark, d), ingest.IngestSettings().overlap)
    tied = F.when(F.col("connection_id").endswith("7"), F.unix_millis(timestamp(MID))).otherwise(F.col("start_ms"))
    history = ingest.staged(sample.history(spark, d).withColumn("start_ms", tied), scratch_dir(spark, "history"))
    # At least three pages for the largest connection, and more of a connection than a page at one instant.
    largest = history.groupBy("connection_id").count().agg(F.max("count")).first()[0]
    pages = source.drained(
        history, plan, max(1, largest // 4), lambda page: ingest.staged(page, scratch_dir(spark, "page"))
    )
    found = reduce(DataFrame.unionByName, pages)
    return found.select("connection_id", "query_id", "start_ms", "query_text", "execution_time_ms")


@query
def readable_rows(spark, d):
    return source.readable_rows(sample.history(spark, d))


@query
def unreadable_counts(spark, d):
    return source.page_counts(sample.history(spark, d))


@query
def storage_scan(spark, d):
    return sample.storage(spark, d)


@query
def normalized_events(spark, d):
    return source.to_events(source.readable_rows(sample.history(spark, d)), timestamp(NOW)).drop("fingerprint")


@query
def internal_traffic(spark, d):
    flagged = sample.base_events(spark, d).withColumn("is_internal", source.internal_traffic())
    return flagged.select("connection_id", "query_id", "is_internal")


def _deliveries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The first three weeks as first read, while runs were under way; everything but the first week as read again."""
    events = sample.events(spark, d)
    first = (
        events.where(F.col("start_time") < timestamp(WEEKS.end))
        .withColumn("end_time", F.lit(None).cast("timestamp"))
        .withColumn("total_elapsed_time_ms", F.lit(None).cast("long"))
        .withColumn("bytes_spilled_to_disk", F.lit(None).cast("long"))
        .withColumn("user_agent", F.lit(None).cast("string"))
        .withColumn("is_internal", F.lit(False))
        .withColumn("fingerprint", F.lit("0123456789abcdef"))
        .withColumn("ingested_at", timestamp(WEEKS.end))
    )
    again = (
        events.where(F.col("start_time") >= timestamp(WEEKS.start))
        .withColumn("user_name", F.when(F.col("bytes_downloaded") % 200 == 0, F.col("user_name")))
        .withColumn("query_text", F.concat(F.lit("changed "), "query_text"))
    )
    return first, again


@query
def event_upsert(spark, d):
    return merge.upsert_events(*_deliveries(spark, d))


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    first, again = _deliveries(spark, d)
    return first.withColumn("seq", F.lit(1)).unionByName(again.withColumn("seq", F.lit(2)))


@query
def event_fold(spark, d):
    return merge.fold_deliveries(_numbered(spark, d), "seq")


@query
def event_upsert_one_batch(spark, d):
    """Both deliveries in one batch, in no order but their number."""
    return merge.upsert_events(sample.events(spark, d).limit(0), _numbered(spark, d).repartition(7 * _files(spark, d), "query_text"))


@query
def event_upsert_stored(spark, d):
    """The deliveries through the stored tables, the second in one batch with a repeat of the first."""
    stored = Tables(spark, scratch_dir(spark, "ledger"), slot_hours=24)
    first, _ = _deliveries(spark, d)
    stored.upsert_events(first)
    stored.upsert_events(_numbered(spark, d))
    return stored.events().drop(*LAYOUT)


@query
def event_upsert_moved(spark, d):
    """A fifth of the re-reads reports another start. Half of the runs are in their slots when that comes, half are deltas."""
    stored = Tables(spark, scratch_dir(spark, "ledger"), slot_hours=24)
    first, again = _deliveries(spark, d)
    known = F.col("start_time") < timestamp(WEEKS.end)
    moves = known & (F.pmod(F.xxhash64("query_id"), F.lit(5)) == 0)
    moved = F.when(moves, F.col("start_time") + F.expr("interval 75 hours")).otherwise(F.col("start_time"))
    half = F.pmod(F.xxhash64("query_id", "connection_id"), F.lit(2)) == 0
    stored.append_events(first.where(half), "early", 0)
    stored.compact()
    stored.append_events(first.where(~half), "early", 1)
    stored.append_events(again.withColumn("start_time", moved), "late", 0)
    return stored.events().drop(*LAYOUT)


@query
def shape_registry(spark, d):
    events = sample.stamped_events(spark, d)
    late = shapes.new_shapes(events.where(F.col("start_time") >= timestamp(MID)))
    return shapes.register_shapes(late, events)


@query
def storage_append(spark, d):
    samples = sample.storage(spark, d)
    split = timestamp(datetime(1998, 1, 1))
    stored = samples.where(F.col("computed_at") < split)
    batch = samples.withColumn("active_bytes", F.col("active_bytes") + 1)
    return storage.append_samples(stored, batch)


@query
def pending_fingerprints(spark, d):
    return merge.pending_fingerprints(sample.events(spark, d))


@query
def fingerprint_backfill(spark, d):
    events = sample.events(spark, d)
    assigned = shapes.fingerprinted(merge.pending_fingerprints(events))
    return merge.backfill_fingerprints(events, assigned).select("connection_id", "query_id", "fingerprint")


def _half_examined(spark: SparkSession, d: str) -> DataFrame:
    examined = F.when(F.col("first_seen") < timestamp(MID), F.col("antipatterns"))
    return sample.shapes(spark, d).withColumn("antipatterns", examined)


@query
def pending_flags(spark, d):
    return shapes.pending_flags(_half_examined(spark, d))


@query
def flag_backfill(spark, d):
    stored = _half_examined(spark, d)
    return shapes.backfill_flags(stored, shapes.pending_flags(stored)).select(
        "connection_id", "fingerprint", "antipatterns"
    )


@query
def purge_connection(spark, d):
    gone = sample.connections(spark, d).where(~F.col("enabled"))
    return merge.purge(sample.events(spark, d), gone).select("connection_id", "query_id", "start_time")


@query
def event_detail(spark, d):
    stored = sample.ledger(spark, d)
    listed = reads.slow_queries(stored.events(), stored.connections(), everything())
    return reads.event_details(stored.events(), stored.connections(), listed).drop(*UNLISTED)


@query
def event_lookup(spark, d):
    """Events by their keys, among them some that are not stored."""
    stored = sample.ledger(spark, d)
    keys = stored.events().where(F.col("query_id").startswith("00")).select("connection_id", "query_id")
    unknown = keys.withColumn("query_id", F.concat("query_id", F.lit("-")))
    return stored.lookup(keys.unionByName(unknown)).drop(*UNLISTED)


@query
def shape_statement(spark, d):
    stored = sample.ledger(spark, d)
    found = findings.all_findings(stored.events(), stored.shapes(), stored.connections(), everything())
    return shapes.shape_statements(stored.shapes(), found)


# Filters -------------------------------------------------------------------------------------------------------------


@query
def search_events(spark, d):
    found = reads.select_events(sample.ledger(spark, d).events(), everything(search="FROM clicks_1"))
    return found.select("connection_id", "query_id", "query_text")


@query
def filtered_events(spark, d):
    wanted = everything(
        WEEKS, include_internal=True, user_name="user_7", query_type="QUERY", min_duration_ms=1000
    )
    found = reads.select_events(sample.ledger(spark, d).events(), wanted)
    return found.select("connection_id", "query_id", "start_time", "total_elapsed_time_ms")


@query
def shape_runs(spark, d):
    one = hashlib.sha256(VIEW_SHAPE.encode()).hexdigest()[:16]
    found = reads.select_events(sample.ledger(spark, d).events(), everything(fingerprint=one))
    return found.select("connection_id", "query_id", "fingerprint")


@query
def filter_values(spark, d):
    return reads.filter_values(sample.ledger(spark, d).events(), everything())


# Statements ----------------------------------------------------------------------------------------------------------


def _normalized(spark: SparkSession, d: str) -> DataFrame:
    return statements.with_normalized(sample.base_events(spark, d), "query_text")


@query
def normalize_statements(spark, d):
    return _normalized(spark, d).select("connection_id", "query_id", "normalized_sql")


@query
def fingerprints(spark, d):
    stamped = statements.fingerprint_of(F.col("normalized_sql")).alias("fingerprint")
    return _normalized(spark, d).select("connection_id", "query_id", stamped)


@query
def shape_keys(spark, d):
    keyed = _normalized(spark, d).withColumn("shape_key", statements.shape_key(F.col("normalized_sql")))
    stamped = statements.fingerprint_of(F.col("shape_key")).alias("fingerprint")
    return keyed.select("connection_id", "query_id", "shape_key", stamped)


@query
def shape_groups(spark, d):
    """Which statements are of one shape: each with the first of its group and the group's size."""
    keyed = statements.with_normalized(sample.variants(spark, d), "query_text")
    keyed = keyed.select("query_id", statements.fingerprint_of(statements.shape_key(F.col("normalized_sql"))).alias("shape"))
    groups = keyed.groupBy("shape").agg(F.min("query_id").alias("same_as"), F.count("*").alias("members"))
    return keyed.join(groups, "shape").select("query_id", "same_as", "members")


@query
def statement_flags(spark, d):
    found = statements.flags(F.col("normalized_sql")).alias("antipatterns")
    return _normalized(spark, d).select("connection_id", "query_id", found)


@query
def statement_preview(spark, d):
    return sample.base_events(spark, d).select(
        "connection_id", "query_id", statements.one_line(F.col("query_text")).alias("preview")
    )


@query
def document_statements(spark, d):
    """Free text of any length and alphabet through the statement path."""
    sample.tune(spark)
    text = F.col("text")
    normalized = F.col("normalized_sql")
    documents = statements.with_normalized(spread(spark.read.parquet(f"{d}/documents.parquet")), "text")
    return documents.select(
        "doc_id",
        statements.fingerprint_of(normalized).alias("fingerprint"),
        F.length(normalized).cast("long").alias("normalized_length"),
        statements.fingerprint_of(statements.one_line(text)).alias("preview_hash"),
        statements.cut(text, statements.PREVIEW_LEN).alias("listed"),
        statements.labelled(
            statements.cut(text, statements.PREVIEW_LEN),
            statements.is_cut(text, statements.PREVIEW_LEN),
            statements.PREVIEW_LEN,
        ).alias("copied"),
    )


# Reads ---------------------------------------------------------------------------------------------------------------


def _read(operator, span: TimeRange = MONTH, *more):
    def run(spark: SparkSession, d: str) -> DataFrame:
        stored = sample.ledger(spark, d)
        return operator(stored.events(), stored.connections(), everything(span), *more)

    return run


def _named(name: str, build: Query) -> None:
    build.__name__ = name
    query(build)


_named("summary", _read(reads.summary))
_named("summary_by_instance_type", _read(reads.summary_by_instance_type))
_named("latency_buckets", _read(reads.latency_buckets))
_named("cost_buckets", _read(reads.cost_buckets))
_named("attribution_by_user", _read(reads.attribution, HALF, "user_name"))
_named("attribution_by_instance_type", _read(reads.attribution, HALF, "instance_type"))
_named("attribution_totals", _read(reads.attribution_totals, HALF))
_named("slow_queries", lambda spark, d: _read(reads.slow_queries)(spark, d).drop(*UNLISTED))
_named(
    "slow_queries_oldest",
    lambda spark, d: _read(reads.slow_queries, MONTH, ListOptions("started", "asc", 500))(spark, d).drop(*UNLISTED),
)
_named("recent_failures", lambda spark, d: _read(reads.recent_failures)(spark, d).drop(*UNLISTED))


@query
def event_costs(spark, d):
    stored = sample.ledger(spark, d)
    priced = reads.with_run_cost(stored.events(), stored.connections())
    return priced.select("connection_id", "query_id", "instance_type", "estimated_cost_usd")


@query
def latency_segments(spark, d):
    return charts.latency_segments(_read(reads.latency_buckets, MONTH, False)(spark, d))


@query
def chart_digest(spark, d):
    return charts.chart_digest(_read(reads.latency_buckets, MONTH, False)(spark, d))


@query
def chart_digest_cost(spark, d):
    return charts.chart_digest(_read(reads.cost_buckets, MONTH, False)(spark, d).withColumn("failure_count", F.lit(0)), "cost")


def _shaped(operator):
    def run(spark: SparkSession, d: str) -> DataFrame:
        stored = sample.ledger(spark, d)
        return operator(stored.events(), stored.shapes(), stored.connections(), everything())

    return run


_named("shapes", _shaped(shapes.top_shapes))
_named("insights", _shaped(findings.insights))
_named("insight_totals", _shaped(findings.insight_totals))
_named("insights_by_shape", _shaped(findings.insights_by_shape))


# Cells of whole slots instead of events ------------------------------------------------------------------------------


def _from_cells(operator, span: TimeRange, *more) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        stored = sample.ledger(spark, d)
        return operator(stored.cells(), stored.connections(), everything(span), *more, stored.slot_hours)

    return run


@query
def summary_from_cells(spark, d):
    stored = sample.ledger(spark, d)
    return cells.summary_from_cells(stored.cells(), stored.histogram(), stored.connections(), everything(), stored.slot_hours)


_named("summary_by_instance_type_from_cells", _from_cells(cells.summary_by_instance_type_from_cells, MONTH))
_named("attribution_from_cells", _from_cells(cells.attribution_from_cells, HALF, "user_name"))


@query
def shapes_from_cells(spark, d):
    stored = sample.ledger(spark, d)
    figures = cells.shape_figures_from_cells(stored.cells(), stored.connections(), everything(), stored.slot_hours)
    return shapes.listed_shapes(figures, stored.shapes(), everything())


# Storage -------------------------------------------------------------------------------------------------------------


@query
def storage_latest(spark, d):
    return storage.latest_samples(sample.ledger(spark, d).storage())


@query
def storage_by_database(spark, d):
    stored = sample.ledger(spark, d)
    return storage.storage_by_database(stored.storage(), stored.connections())


@query
def storage_summary(spark, d):
    stored = sample.ledger(spark, d)
    return storage.storage_summary(stored.storage(), stored.connections())


# Ingest bookkeeping --------------------------------------------------------------------------------------------------


@query
def ingestion_health(spark, d):
    return health.ingestion_health(sample.connections(spark, d), timestamp(NOW), health.stale_after(POLL))


@query
def fetch_plan(spark, d):
    return ingest.fetch_plan(sample.connections(spark, d), ingest.IngestSettings().overlap)


@query
def advance_watermark(spark, d):
    drafts = source.readable_rows(sample.history(spark, d))
    return ingest.advance_watermark(sample.connections(spark, d), ingest.newest_starts(drafts))


def _outcome(spark: SparkSession, d: str) -> DataFrame:
    plan = ingest.fetch_plan(sample.connections(spark, d), ingest.IngestSettings().overlap)
    return ingest.sync_outcome(plan, ingest.batch_stats(_page(spark, d)), PAGE)


@query
def sync_outcome(spark, d):
    return _outcome(spark, d)


@query
def sync_state(spark, d):
    return ingest.apply_sync_state(sample.connections(spark, d), _outcome(spark, d), timestamp(NOW))


@query
def storage_due(spark, d):
    return ingest.storage_due(sample.connections(spark, d), timestamp(NOW), ingest.IngestSettings().storage_interval)


def _troubled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Connections, history and fetch errors of a pass in which one connection is stalled and some fail to be read."""
    hot = F.col("id") == HOT
    connections = sample.connections(spark, d).withColumn("catching_up", F.col("catching_up") | hot)
    at_mark = F.when(F.col("connection_id") == HOT, F.unix_millis(timestamp(MID))).otherwise(F.col("start_ms"))
    failing = connections.where(F.col("id").endswith("3")).select(F.col("id").alias("connection_id"), F.lit("no route").alias("fetch_error"))
    return connections, sample.history(spark, d).withColumn("start_ms", at_mark), failing


@query
def ingest_pass(spark, d):
    """One pass over all connections: events and storage stored, books kept."""
    stored = Tables(spark, scratch_dir(spark, "ledger"), slot_hours=24)
    connections, history, failing = _troubled(spark, d)
    stored.record_connections(connections, 0)
    settings = ingest.IngestSettings(batch_limit=PAGE)
    ingest.ingest_pass(
        stored, history, 1, scratch_dir(spark, "staging"), timestamp(NOW), settings, sample.raw_storage(spark, d), failing
    )
    found = stored.events().groupBy(F.col("connection_id").alias("id")).agg(F.count("*").alias("events_stored"))
    held = stored.storage().groupBy(F.col("connection_id").alias("id")).agg(F.count("*").alias("samples_stored"))
    state = stored.connections().join(found, "id", "left").join(held, "id", "left")
    return state.fillna(0, ["events_stored", "samples_stored"])


# Streams -------------------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, d: str) -> int:
    """How many files stand where a small history has one, so that none outgrows a task; micro-batches stay as many."""
    return 1 + spark.read.parquet(f"{d}/events.parquet").count() // 500_000


def _history_table(spark: SparkSession, d: str) -> str:
    """The derived history as files, which is what a stream reads. Spread over files so that there are several batches.

    Every run is delivered twice: first under way, without its agent, so that own traffic shows late.
    """
    path, history, files = scratch_dir(spark, "history"), sample.history(spark, d), _files(spark, d)
    under_way = (
        history.withColumn("user_agent", F.lit(None).cast("string"))
        .withColumn("total_elapsed_time_ms", F.col("total_elapsed_time_ms") + 17)
        .withColumn("error_type", F.lit(None).cast("string"))
    )
    under_way.repartition(2 * files, "query_id").write.parquet(path)
    history.repartition(3 * files, "query_text").write.mode("append").parquet(path)
    return path


def _streamed(spark: SparkSession, d: str) -> Tables:
    stored = Tables(spark, scratch_dir(spark, "ledger"), slot_hours=24)
    stored.record_connections(sample.connections(spark, d), 0)
    # The second micro-batch holds first and second deliveries.
    stream = live.stream_upsert(
        source.stream_history(spark, _history_table(spark, d), 3 * _files(spark, d)),
        stored,
        scratch_dir(spark, "work"),
        scratch_dir(spark, "upsert-progress"),
        now=NOW,
        settings=ingest.IngestSettings(batch_limit=1_000_000_000),
    )
    stream.awaitTermination()
    return stored


@query
def stream_upsert(spark, d):
    return _streamed(spark, d).events().drop(*LAYOUT)


@query
def stream_sync_state(spark, d):
    """The books that the stream kept. How many rows a micro-batch lost depends on the files, that it lost some does not."""
    state = _streamed(spark, d).connections()
    skipped = F.col("last_ingest_warning").contains("skipped")
    return state.withColumn("last_ingest_warning", F.when(skipped, "skipped"))


@query
def stream_latency(spark, d):
    path, folder, files = scratch_dir(spark, "live"), _history_table(spark, d), _files(spark, d)
    # A third of the runs is delivered once more, in files of their own.
    again = sample.history(spark, d).where(F.pmod(F.xxhash64("query_id"), F.lit(3)) == 0)
    again.repartition(3 * files, "query_text").write.mode("append").parquet(folder)
    stream = live.stream_latency(source.stream_history(spark, folder, 3 * files), path, scratch_dir(spark, "latency-progress"))
    stream.awaitTermination()
    return live.live_latency(spark, path, "6 hours")


# One connection ------------------------------------------------------------------------------------------------------


def _of_one(name: str, build: Query) -> None:
    _named(f"{name}_of_one", build)


ONE = dict(connection_id=HOT)


def _read_one(operator, span: TimeRange = MONTH, *more) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        stored = sample.ledger(spark, d)
        found = operator(stored.events(), stored.connections(), everything(span, **ONE), *more)
        return found.drop(*[name for name in UNLISTED if operator in (reads.slow_queries, reads.recent_failures)])

    return run


for _name, _operator, *_more in (
    ("summary", reads.summary),
    ("summary_by_instance_type", reads.summary_by_instance_type),
    ("latency_buckets", reads.latency_buckets),
    ("cost_buckets", reads.cost_buckets),
    ("attribution_by_user", reads.attribution, HALF, "user_name"),
    ("attribution_by_instance_type", reads.attribution, HALF, "instance_type"),
    ("attribution_totals", reads.attribution_totals, HALF),
    ("slow_queries", reads.slow_queries),
    ("recent_failures", reads.recent_failures),
):
    _of_one(_name, _read_one(_operator, *_more))


def _shaped_one(operator) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        stored = sample.ledger(spark, d)
        return operator(stored.events(), stored.shapes(), stored.connections(), everything(**ONE))

    return run


for _name, _operator in (
    ("shapes", shapes.top_shapes),
    ("insights", findings.insights),
    ("insight_totals", findings.insight_totals),
    ("insights_by_shape", findings.insights_by_shape),
):
    _of_one(_name, _shaped_one(_operator))

_of_one("filter_values", lambda spark, d: reads.filter_values(sample.ledger(spark, d).events(), everything(**ONE)))
_of_one(
    "search_events",
    lambda spark, d: reads.select_events(sample.ledger(spark, d).events(), everything(search="FROM clicks_1", **ONE)).select(
        "connection_id", "query_id", "query_text"
    ),
)
_of_one("latency_segments", lambda spark, d: charts.latency_segments(_read_one(reads.latency_buckets, MONTH, False)(spark, d)))
_of_one("chart_digest", lambda spark, d: charts.chart_digest(_read_one(reads.latency_buckets, MONTH, False)(spark, d)))
