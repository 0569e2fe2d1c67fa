"""The driver's tables seen as query history, storage measurements and connections.

The texts run unchanged on Spark and on the SQL oracle, apart from the placeholders of ``SPARK`` and ``ORACLE``. One
connection holds a third of all events, the rest belong to one connection per user, so the number of connections and the
weight of the hot one both grow with the data. Nothing reads the wall clock.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from runledger.operators.shapes import fingerprinted_by_text, new_shapes
from runledger.plans.params import EventFilter, TimeRange, timestamp
from runledger.schema import EVENTS, HISTORY
from runledger.session import scratch_dir, size_shuffles, spread, tune
from runledger.sources.history import internal_traffic, storage_scan
from runledger.sources.tables import Tables

NOW = datetime(2024, 1, 31)
MONTH = TimeRange(datetime(2024, 1, 1), NOW)
# Half a month, so that the period before it holds the other half of the events.
HALF = TimeRange(datetime(2024, 1, 16), NOW)

ORACLE = {
    "ts": "timestamp",
    "events": "events",
    "orders": "orders",
    "region": "region",
    "plus_ms": "start_time + to_milliseconds(total_elapsed_time_ms)",
    "ms": "epoch_us(start_time) // 1000",
    "end_ms": "epoch_us(end_time) // 1000",
}
SPARK = {
    **ORACLE,
    "ts": "timestamp_ntz",
    "plus_ms": "cast(timestampadd(MILLISECOND, total_elapsed_time_ms, start_time) as timestamp_ntz)",
    "ms": "unix_millis(cast(start_time as timestamp))",
    "end_ms": "unix_millis(cast(end_time as timestamp))",
}

EVENTS_SQL = r"""
select *, {plus_ms} as end_time
from (
  select event_id,
         concat('conn-', cast(case when event_id % 3 = 0 then 8 else user_id end as string)) as connection_id,
         concat(substr(h,1,8),'-',substr(h,9,4),'-',substr(h,13,4),'-',substr(h,17,4),'-',substr(h,21,12)) as query_id,
         case
           when event_id % 13 = 0 then concat('with r as (select "Region", sum(v) as v from sales_',
             cast(user_id % 30 as string), ' where d >= ''2024-01-', k, ''' group by 1) select r."Region", ',
             '(select max(x) from (select x from q where y = ', k, ')) as m', chr(10),
             'from r CROSS  JOIN dims /* it''s a note */ order by 1')
           when event_id % 17 = 0 then concat('select count(*) from log_', cast(user_id % 40 as string),
             ' where a=', k, ' and b in (', k, ',', k, ', 3) union all select 1.5e', k, ' -- done')
           when event_type = 'click' then concat('SELECT * FROM clicks_', cast(user_id % 50 as string), ' WHERE k = ', k)
           when event_type = 'view' then concat('select v.a from views v, pages p where v.id in (', k, ', 7, 8)')
           when event_type = 'purchase' then concat('-- report ', k, chr(10), chr(10), '  -- next', chr(10),
             'select a from purchases order by a')
           when event_type = 'signup' then concat('create table s as select * from signup where d = ''', k, '''')
           else concat('select a from t join u on t.id = u.id where n = ', k, ' limit 10') end as query_text,
         case event_type when 'signup' then 'DDL' when 'error' then null else 'QUERY' end as query_type,
         ts as start_time,
         case when event_id % 11 = 0 then null when event_id % 97 = 0 then cast(-5 as bigint)
              else cast(floor(value * 80) as bigint) end as execution_time_ms,
         case when event_id % 6 = 0 then null else cast(floor(value * 20) as bigint) end as wait_time_ms,
         case when event_id % 121 = 0 then null when event_id % 97 = 0 then cast(-7 as bigint)
              else cast(floor(value * 100) as bigint) end as total_elapsed_time_ms,
         case when event_type = 'error' then concat('E', cast(event_id % 3 as string)) end as error_type,
         case when event_type = 'error' then concat('failed on ', k) end as error_message,
         case when event_id % 25 = 0 then null else concat('user_', cast(event_id % 40 as string)) end as user_name,
         case event_id % 7 when 0 then 'pulse' when 1 then ' Standard ' when 2 then 'jumbo' when 3 then 'mega'
              when 4 then 'giga' when 5 then 'titan' end as instance_type,
         concat('w-', cast(event_id % 9 as string)) as worker_id,
         case when event_id % 8 <> 0 then concat('s-', cast(user_id as string)) end as session_name,
         case when event_id % 5 = 0 then cast(k as bigint) * 10 end as bytes_uploaded,
         cast(k as bigint) * 100 as bytes_downloaded,
         case when cast(k as bigint) > 80 then cast(k as bigint) * 10000000 end as bytes_spilled_to_disk,
         case when event_id % 50 = 3 then 'client/1.0 SelfWatch' when event_id % 50 <> 4 then 'client/1.0' end as user_agent
  from (select *, md5(cast(event_id as string)) as h, regexp_extract(props, '[0-9]+', 0) as k from {events}) x
) y
"""

# Statements in spellings that a parser reads alike, and some that none takes; k is a number, t a table.
VARIANTS_SQL = r"""
select concat('q-', cast(event_id as string)) as query_id,
  case event_id % 23
    when 0 then concat('select a from ', t, ' where n = ', k)
    when 1 then concat('select a from ', t, ' where n = -', k)
    when 2 then concat('SELECT a FROM ', t, ' WHERE n=', k, ';')
    when 3 then concat('select a from ', t, ' where b = ', case when user_id % 2 = 0 then 'true' else 'FALSE' end)
    when 4 then concat('select a from ', t, ' where n != ', k)
    when 5 then concat('select a from ', t, ' where n <> -', k)
    when 6 then concat('select x.a from ', t, ' x join u y on x.i = y.i where x.a > ', k)
    when 7 then concat('select x.a from ', t, ' as x inner join u as y on x.i = y.i where x.a > -', k)
    when 8 then concat('select x.a from ', t, ' as x left join u y on x.i = y.i where x.a > ', k)
    when 9 then concat('select a q, b from ', t, ' v')
    when 10 then concat('select a as q, b from ', t, ' as v')
    when 11 then concat('with r as (select ', k, ' as x) select x from r')
    when 12 then concat('with r as (select -', k, ' x) select x from r')
    when 13 then concat('select a from ', t, ' where n in (', k, ', -', k, case when user_id % 2 = 0 then ', 5' else '' end, ')')
    when 14 then concat('select a where from ', t)
    when 15 then concat('select a b c d from ', t)
    when 16 then concat('select a from ', t, ' group by a where b')
    when 17 then concat('select cast(a as int) as c from ', t, ' where d between -', k, ' and ', k)
    when 18 then concat('select "Q a" as "B b" from ', t)
    when 19 then concat('select "Q a" "B b" from ', t)
    when 20 then concat('create table s as select * from ', t, ' as q where n = -', k)
    when 21 then concat('select a - ', k, ' from ', t, ' where c is distinct from d')
    else concat('select a from ', t, ' where n = ') end as query_text
from (select *, concat('t', cast(user_id % 3 as string)) as t, regexp_extract(props, '[0-9]+', 0) as k from {events}) x
"""

# What the source would return: ids in every accepted form, some unusable ids and times.
HISTORY_SQL = (
    r"""
select connection_id,
       case when event_id % 997 = 5 then 'not-an-id' when event_id % 7 = 1 then upper(replace(query_id, '-', ''))
            when event_id % 7 = 2 then concat('{{', query_id, '}}') when event_id % 7 = 3 then concat('urn:uuid:', query_id)
            else query_id end as query_id,
       query_text, query_type,
       case when event_id % 991 = 3 then 9000000000000000 else {ms} end as start_ms,
       case when event_id % 989 = 4 then 9000000000000000 else {end_ms} end as end_ms,
       execution_time_ms, wait_time_ms, total_elapsed_time_ms, error_type, error_message, user_name, instance_type,
       worker_id, session_name, bytes_uploaded, bytes_downloaded, bytes_spilled_to_disk, user_agent
from ("""
    + EVENTS_SQL
    + ") e"
)

STORAGE_SQL = r"""
select connection_id, database_name, computed_at,
       active_bytes,
       case when active_bytes % 7 <> 0 then cast(floor(active_bytes / 2) as bigint) end as historical_bytes,
       cast(floor(active_bytes / 3) as bigint) as retained_for_clone_bytes,
       cast(floor(active_bytes / 5) as bigint) as failsafe_bytes,
       case when active_bytes % 10 = 3 then computed_at end as deleted_ts
from (
  select concat('conn-', cast(o_custkey % 40 as string)) as connection_id, o_orderpriority as database_name,
         o_orderdate as computed_at,
         cast(sum(cast(floor(o_totalprice * 1000) as bigint)) as bigint) as active_bytes
  from {orders} group by 1, 2, 3
) s
"""

# One connection per user seen in the events, and a quiet one per region.
CONNECTIONS_SQL = r"""
select concat(case when quiet then 'quiet-' else 'conn-' end, cast(u as string)) as id,
       concat('account ', cast(u as string)) as name,
       case u % 4 when 0 then 'tier1' when 1 then ' TIER2 ' when 2 then 'tier3' else 'bad-tier' end as region_tier,
       u % 11 <> 5 as enabled,
       case when quiet or u % 9 = 0 then null else {ts} '2024-01-16 00:00:00' end as watermark_start_time,
       case when u % 13 = 6 then null else newest end as last_synced_at,
       case when u % 13 = 6 or u % 5 = 2 then null else newest end as last_success_at,
       case when u % 7 = 3 then 'fetch failed' end as last_sync_error,
       case when u % 3 = 1 then '2 unreadable rows were skipped' end as last_ingest_warning,
       coalesce(oldest, {ts} '2024-01-01 00:00:00') as created_at,
       coalesce(newest, {ts} '2024-01-01 00:00:00') as updated_at,
       u % 4 = 1 and not quiet and u % 9 <> 0 as catching_up,
       case when u % 10 = 0 then null when u % 2 = 0 then newest else {ts} '2024-01-30 23:30:00' end as storage_attempted_at
from (
  select user_id as u, false as quiet, max(ts) as newest, min(ts) as oldest from {events} group by user_id
  union all
  select cast(r_regionkey as bigint), true, null, null from {region}
) c
"""


def oracle_text(sql: str) -> str:
    return sql.format(**ORACLE)


def _view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """The SQL over parquet files, with the zone-less timestamps of the files as UTC instants."""
    tune(spark)
    files = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in tables}
    size_shuffles(spark, max(rows.count() for rows in files.values()))
    sources = {name: spread(rows) for name, rows in files.items()}
    text = sql.format(**{**SPARK, **{name: f"<{name}>" for name in tables}})
    text = text.replace("{", "{{").replace("}", "}}")  # braces that belong to the SQL itself
    for name in tables:
        text = text.replace(f"<{name}>", f"{{{name}}}")
    rows = spark.sql(text, **sources)
    zoned = [
        F.col(field.name).cast("timestamp").alias(field.name)
        if isinstance(field.dataType, TimestampNTZType)
        else F.col(field.name)
        for field in rows.schema.fields
    ]
    return rows.select(*zoned)


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, EVENTS_SQL, "events")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, VARIANTS_SQL, "events")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, HISTORY_SQL, "events").select(*HISTORY.names)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored events without fingerprints."""
    return (
        base_events(spark, sf_dir)
        .withColumn("is_internal", internal_traffic())
        .withColumn("fingerprint", F.lit(None).cast("string"))
        .withColumn("ingested_at", timestamp(NOW))
        .select(*EVENTS.names)
    )


def stamped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored events with fingerprints."""
    return fingerprinted_by_text(events(spark, sf_dir), scratch_dir(spark, "texts"))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape table those events lead to."""
    return new_shapes(stamped_events(spark, sf_dir))


def raw_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, STORAGE_SQL, "orders")


def storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage_scan(raw_storage(spark, sf_dir), timestamp(NOW))


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, CONNECTIONS_SQL, "events", "region")


_LEDGERS: dict[tuple[str, str], Tables] = {}


def ledger(spark: SparkSession, sf_dir: str) -> Tables:
    """The stored tables all of this leads to, written once per session: what reads find after ingest has run."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LEDGERS:
        tables = Tables(spark, scratch_dir(tune(spark), "ledger"), slot_hours=24)
        tables.load_events(stamped_events(spark, sf_dir))
        tables.register_shapes(tables.events())
        tables.append_storage(storage(spark, sf_dir))
        tables.record_connections(connections(spark, sf_dir), 0)
        _LEDGERS[key] = tables
    return _LEDGERS[key]


def everything(span: TimeRange = MONTH, **options) -> EventFilter:
    """All connections, own traffic hidden as in every read by default."""
    return EventFilter(span, **options)
