"""Small hand-made tables."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession

from runledger.plans.params import TimeRange
from runledger.schema import CONNECTIONS, EVENTS, HISTORY, SHAPES, STORAGE

NOW = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)
DAY = TimeRange(NOW - timedelta(days=1), NOW)


def ago(**span) -> datetime:
    return NOW - timedelta(**span)


def _frame(spark: SparkSession, schema, defaults: dict, rows: list[dict]) -> DataFrame:
    unknown = {name for row in rows for name in row} - set(schema.names)
    assert not unknown, unknown
    return spark.createDataFrame([tuple({**defaults, **row}.get(name) for name in schema.names) for row in rows], schema)


def events(spark, *rows: dict) -> DataFrame:
    defaults = {
        "connection_id": "c",
        "query_text": "select 1",
        "query_type": "QUERY",
        "start_time": ago(minutes=5),
        "user_name": "alice",
        "instance_type": "standard",
        "is_internal": False,
        "ingested_at": NOW,
    }
    named = [{"query_id": str(uuid.UUID(int=index + 1)), **row} for index, row in enumerate(rows)]
    return _frame(spark, EVENTS, defaults, named)


def history(spark, *rows: dict) -> DataFrame:
    defaults = {"connection_id": "c", "query_text": "select 1"}
    named = [{"query_id": str(uuid.UUID(int=index + 1)), "start_ms": 1_700_000_000_000 + index, **row} for index, row in enumerate(rows)]
    return _frame(spark, HISTORY, defaults, named)


def connections(spark, *rows: dict) -> DataFrame:
    defaults = {
        "id": "c",
        "name": "main",
        "region_tier": "tier1",
        "enabled": True,
        "created_at": ago(days=30),
        "updated_at": ago(days=30),
        "catching_up": False,
    }
    return _frame(spark, CONNECTIONS, defaults, list(rows) or [{}])


def shapes(spark, *rows: dict) -> DataFrame:
    defaults = {
        "connection_id": "c",
        "normalized_sql": "select ?",
        "example_sql": "select 1",
        "parsed": True,
        "antipatterns": [],
        "first_seen": ago(days=2),
    }
    return _frame(spark, SHAPES, defaults, list(rows))


def samples(spark, *rows: dict) -> DataFrame:
    defaults = {
        "connection_id": "c",
        "computed_at": ago(hours=1),
        "active_bytes": 0,
        "historical_bytes": 0,
        "retained_for_clone_bytes": 0,
        "failsafe_bytes": 0,
        "ingested_at": NOW,
    }
    return _frame(spark, STORAGE, defaults, list(rows))
