"""Table schemas. Every table is declared; nothing is inferred.

``antipatterns`` distinguishes null (not examined yet) from an empty array (examined, clean).
"""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_S, _L, _B, _TS, _D = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampType(), T.DateType()

# One history row as the warehouse reports it: times are epoch milliseconds, the id is unchecked text.
HISTORY = _struct(
    ("connection_id", _S, False),
    ("query_id", _S, True),
    ("query_text", _S, True),
    ("query_type", _S, True),
    ("start_ms", _L, True),
    ("end_ms", _L, True),
    ("execution_time_ms", _L, True),
    ("wait_time_ms", _L, True),
    ("total_elapsed_time_ms", _L, True),
    ("error_type", _S, True),
    ("error_message", _S, True),
    ("user_name", _S, True),
    ("instance_type", _S, True),
    ("worker_id", _S, True),
    ("session_name", _S, True),
    ("bytes_uploaded", _L, True),
    ("bytes_downloaded", _L, True),
    ("bytes_spilled_to_disk", _L, True),
    ("user_agent", _S, True),
)

# The event table, keyed by (connection_id, query_id).
EVENTS = _struct(
    ("connection_id", _S, False),
    ("query_id", _S, False),
    ("query_text", _S, False),
    ("query_type", _S, True),
    ("start_time", _TS, False),
    ("end_time", _TS, True),
    ("execution_time_ms", _L, True),
    ("wait_time_ms", _L, True),
    ("total_elapsed_time_ms", _L, True),
    ("error_type", _S, True),
    ("error_message", _S, True),
    ("user_name", _S, True),
    ("instance_type", _S, True),
    ("worker_id", _S, True),
    ("session_name", _S, True),
    ("bytes_uploaded", _L, True),
    ("bytes_downloaded", _L, True),
    ("bytes_spilled_to_disk", _L, True),
    ("user_agent", _S, True),
    ("is_internal", _B, False),
    ("fingerprint", _S, True),
    ("ingested_at", _TS, False),
)

# The shape table, keyed by (connection_id, fingerprint).
SHAPES = _struct(
    ("connection_id", _S, False),
    ("fingerprint", _S, False),
    ("normalized_sql", _S, False),
    ("example_sql", _S, False),
    ("parsed", _B, False),
    ("antipatterns", T.ArrayType(_S), True),
    ("first_seen", _TS, False),
)

# Storage measurements, keyed by (connection_id, database_name, computed_at).
STORAGE = _struct(
    ("connection_id", _S, False),
    ("database_name", _S, False),
    ("computed_at", _TS, False),
    ("active_bytes", _L, False),
    ("historical_bytes", _L, False),
    ("retained_for_clone_bytes", _L, False),
    ("failsafe_bytes", _L, False),
    ("ingested_at", _TS, False),
)

STORAGE_BYTES = ("active_bytes", "historical_bytes", "retained_for_clone_bytes", "failsafe_bytes")

# Connections with their ingest bookkeeping. The last two columns replace in-process poller memory.
CONNECTIONS = _struct(
    ("id", _S, False),
    ("name", _S, False),
    ("region_tier", _S, False),
    ("enabled", _B, False),
    ("watermark_start_time", _TS, True),
    ("last_synced_at", _TS, True),
    ("last_success_at", _TS, True),
    ("last_sync_error", _S, True),
    ("last_ingest_warning", _S, True),
    ("created_at", _TS, False),
    ("updated_at", _TS, False),
    ("catching_up", _B, False),
    ("storage_attempted_at", _TS, True),
)

# The flag names, statement flags first (they are stored), then the two that are computed on read.
STATEMENT_FLAGS = ("select_star", "cross_join", "no_filter", "order_without_limit")
RUNTIME_FLAGS = ("spilling", "repeated_runs")
KNOWN_FLAGS = STATEMENT_FLAGS + RUNTIME_FLAGS

# How this engine's own traffic is recognised in a history: an agent tag and a comment in the statement.
SELF_AGENT_TAG = "selfwatch"
SELF_SQL_MARKER = "-- selfwatch"
