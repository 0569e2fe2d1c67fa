"""All reads of one connection behind one object."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.operators import charts, findings, health, reads, shapes, storage
from runledger.functions.statements import PREVIEW_LEN
from runledger.plans.params import DEFAULT_LIST_LIMIT, MAX_LIST_LIMIT, EventFilter, ListOptions, TimeRange, timestamp


class NotFound(LookupError):
    pass


class Dashboard:
    """Reads for one connection. Every method returns a lazy DataFrame; an unknown connection raises at once.

    Lists are for people: they hold at most ``max_list`` rows, and statements of at most ``preview`` characters, marked
    where they are cut. None lifts either.
    """

    def __init__(
        self,
        connection_id: str,
        events: DataFrame,
        shapes: DataFrame,
        samples: DataFrame,
        connections: DataFrame,
        max_list: int | None = MAX_LIST_LIMIT,
        preview: int | None = PREVIEW_LEN,
    ) -> None:
        own = connections.where(F.col("id") == connection_id)
        if own.isEmpty():
            raise NotFound(f"no connection {connection_id}")
        self.max_list, self.preview = max_list, preview
        self.connection_id = connection_id
        self._connections = own
        self._events = events
        self._shapes = shapes.where(F.col("connection_id") == connection_id)
        self._samples = samples.where(F.col("connection_id") == connection_id)

    def filter(self, span: TimeRange, **options) -> EventFilter:
        return EventFilter(span, connection_id=self.connection_id, **options)

    def _capped(self, limit: int | None) -> int | None:
        return min((n for n in (limit, self.max_list) if n is not None), default=None)

    def _listed(self, options: ListOptions) -> ListOptions:
        return replace(options, limit=self._capped(options.limit), preview=self.preview)

    def _mine(self, flt: EventFilter) -> EventFilter:
        if flt.connection_id != self.connection_id:
            raise ValueError("the filter names another connection")
        return flt

    def summary(self, flt: EventFilter) -> DataFrame:
        return reads.summary(self._events, self._connections, self._mine(flt))

    def summary_by_instance_type(self, flt: EventFilter) -> DataFrame:
        return reads.summary_by_instance_type(self._events, self._connections, self._mine(flt))

    def latency(self, flt: EventFilter) -> DataFrame:
        return reads.latency_buckets(self._events, self._connections, self._mine(flt))

    def cost(self, flt: EventFilter) -> DataFrame:
        return reads.cost_buckets(self._events, self._connections, self._mine(flt))

    def latency_segments(self, flt: EventFilter) -> DataFrame:
        return charts.latency_segments(self._buckets(flt)).orderBy("segment_start")

    def _buckets(self, flt: EventFilter) -> DataFrame:
        return reads.latency_buckets(self._events, self._connections, self._mine(flt), ordered=False)

    def chart_digest(self, flt: EventFilter, measure: str = "count") -> DataFrame:
        return charts.chart_digest(self._buckets(flt), measure)

    def attribution(self, flt: EventFilter, key: str) -> DataFrame:
        return reads.attribution(self._events, self._connections, self._mine(flt), key)

    def attribution_totals(self, flt: EventFilter) -> DataFrame:
        return reads.attribution_totals(self._events, self._connections, self._mine(flt))

    def slow_queries(self, flt: EventFilter, options: ListOptions = ListOptions()) -> DataFrame:
        return reads.slow_queries(self._events, self._connections, self._mine(flt), self._listed(options))

    def recent_failures(
        self, flt: EventFilter, options: ListOptions = ListOptions(sort="started", failures_only=True)
    ) -> DataFrame:
        return reads.recent_failures(self._events, self._connections, self._mine(flt), self._listed(options))

    def event(self, query_id: str) -> DataFrame:
        """One event with its full text and cost."""
        row = self._events.where((F.col("connection_id") == self.connection_id) & (F.col("query_id") == query_id))
        if row.isEmpty():
            raise NotFound(f"no query {query_id}")
        return reads.with_run_cost(row, self._connections)

    def shapes(self, flt: EventFilter, limit: int = DEFAULT_LIST_LIMIT) -> DataFrame:
        return shapes.top_shapes(
            self._events, self._shapes, self._connections, self._mine(flt), self._capped(limit), self.preview
        )

    def shape_statement(self, fingerprint: str) -> DataFrame:
        row = self._shapes.where(F.col("fingerprint") == fingerprint)
        if row.isEmpty():
            raise NotFound(f"no shape {fingerprint}")
        return row.select("fingerprint", "example_sql", "parsed", "first_seen")

    def insights(self, flt: EventFilter, limit: int = DEFAULT_LIST_LIMIT) -> DataFrame:
        return findings.insights(
            self._events, self._shapes, self._connections, self._mine(flt), self._capped(limit), self.preview
        )

    def insight_totals(self, flt: EventFilter) -> DataFrame:
        return findings.insight_totals(self._events, self._shapes, self._connections, self._mine(flt))

    def insights_by_shape(self, flt: EventFilter) -> DataFrame:
        return findings.insights_by_shape(self._events, self._shapes, self._connections, self._mine(flt))

    def storage(self) -> DataFrame:
        return storage.storage_summary(self._samples, self._connections)

    def storage_by_database(self) -> DataFrame:
        return storage.storage_by_database(self._samples, self._connections)

    def filter_values(self, span: TimeRange) -> DataFrame:
        return reads.filter_values(self._events, self.filter(span))

    def health(self, now: datetime, poll_interval: timedelta = timedelta(seconds=60)) -> DataFrame:
        return health.ingestion_health(self._connections, timestamp(now), health.stale_after(poll_interval))
