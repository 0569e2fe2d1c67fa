"""The same results in SQL, written against the tables and not against the library.

Statement flags are read from the SQL engine's own parse tree, normalization works token by token, percentiles are the
engine's, and prices come from the per-size triple: each a different route from the one the library takes.
"""

from __future__ import annotations

from checks.queries import HOT, PAGE, VIEW_SHAPE
from checks.sample import CONNECTIONS_SQL, EVENTS_SQL, HISTORY_SQL, STORAGE_SQL, VARIANTS_SQL, oracle_text
from runledger.functions.text import BLANK_CLASS, PREVIEW_SPACE, char_class

_MONTH = ("2024-01-01", "2024-01-31")
_HALF = ("2024-01-16", "2024-01-31")
_BEFORE = ("2024-01-01", "2024-01-16")
_NOW = "timestamp '2024-01-31'"
_HALF_DAY = 43200

_REGISTRY: dict[str, str] = {}


def registry() -> dict[str, str]:
    return dict(_REGISTRY)


# Building blocks -----------------------------------------------------------------------------------------------------

_RATES = """
rt(tier, size, usd, gb) as (values
  ('tier1','pulse',0.60,0.04), ('tier1','standard',2.40,0.04), ('tier1','jumbo',4.80,0.04), ('tier1','mega',12.00,0.04),
  ('tier1','giga',24.00,0.04),
  ('tier2','pulse',0.73,0.043), ('tier2','standard',2.93,0.043), ('tier2','jumbo',5.86,0.043),
  ('tier2','mega',14.65,0.043), ('tier2','giga',29.30,0.043),
  ('tier3','pulse',0.77,0.044), ('tier3','standard',3.10,0.044), ('tier3','jumbo',6.19,0.044),
  ('tier3','mega',15.48,0.044), ('tier3','giga',30.96,0.044))"""

_EVENTS = f"""
ev as (select *, coalesce(contains(lower(user_agent), 'selfwatch'), false) or contains(query_text, '-- selfwatch')
         as is_internal from ({oracle_text(EVENTS_SQL)}) e)"""
_HISTORY = f"hi as ({oracle_text(HISTORY_SQL)})"
_CONNECTIONS = f"""
cn as ({oracle_text(CONNECTIONS_SQL)}),
ti as (select id as connection_id, case when lower(trim(region_tier)) in ('tier2', 'tier3') then lower(trim(region_tier))
         else 'tier1' end as tier from cn)"""
_STORAGE = f"""
raw_st as ({oracle_text(STORAGE_SQL)}),
st as (select connection_id, database_name, computed_at, active_bytes, coalesce(historical_bytes, 0) as historical_bytes,
         retained_for_clone_bytes, failsafe_bytes from raw_st where deleted_ts is null)"""


def _money(expression: str, name: str) -> str:
    return f"round(({expression}) + 1e-9, 6) as {name}"


def _span(bounds: tuple[str, str]) -> str:
    return f"start_time >= timestamp '{bounds[0]}' and start_time < timestamp '{bounds[1]}'"


_BILLED = "coalesce(execution_time_ms, total_elapsed_time_ms)"
_TRIPLE = f"""
  cast(coalesce(sum(greatest({_BILLED}, 0)), 0) as bigint) as total_ms,
  count(*) filter (where coalesce({_BILLED}, 0) < 1000) as sub_second_count,
  cast(coalesce(sum(greatest({_BILLED}, 0)) filter (where coalesce({_BILLED}, 0) < 1000), 0) as bigint) as sub_second_ms"""
_SIZE = "coalesce(instance_type, 'unknown')"


def _cells(name: str, key: str, bounds: tuple[str, str], extra: str = "", source: str = "ev") -> str:
    """CTEs: groups by key and size, and the same priced."""
    return f"""
{name}_raw as (select connection_id, {key}, {_SIZE} as size, count(*) as n,
    count(*) filter (where error_type is not null) as failures, {extra} {_TRIPLE}
  from {source} where not is_internal and {_span(bounds)} group by all),
{name} as (select c.*, coalesce(case when lower(trim(c.size)) = 'pulse'
    then (c.total_ms - c.sub_second_ms) / 1000.0 + c.sub_second_count else c.total_ms / 1000.0 end / 3600.0 * rt.usd, 0) as cost
  from {name}_raw c join ti using (connection_id)
  left join rt on rt.tier = ti.tier and rt.size = lower(trim(c.size)))"""


def _oracle(name: str, ctes: list[str], body: str) -> None:
    _REGISTRY[name] = "with " + ",\n".join(ctes) + "\n" + body


# Statements ----------------------------------------------------------------------------------------------------------

_TOKENS = (
    f"(?s)(?:[{BLANK_CLASS}]|--[^\\n]*|/\\*.*?(?:\\*/|\\z))+"
    "|''[^'']*(?:''''[^'']*)*''?"
    '|"[^"]*(?:""[^"]*)*"?'
    "|[\\p{L}\\p{M}_][\\p{L}\\p{M}\\p{N}_]*|[0-9][0-9.]*|."
)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _normalized(text: str) -> str:
    token = (
        f"case when regexp_matches(t, '^(?:[{BLANK_CLASS}]|--|/\\*)') then ' ' "
        "when starts_with(t, '''') or regexp_matches(t, '^[0-9]') then '?' when starts_with(t, '\"') then t "
        f"else translate(t, '{_UPPER}', '{_UPPER.lower()}') end"
    )
    joined = f"array_to_string(list_transform(regexp_extract_all({text}, '{_TOKENS}'), lambda t: {token}), '')"
    trimmed = f"regexp_replace({joined}, '^[{BLANK_CLASS}]+|[{BLANK_CLASS}]+$', '', 'g')"
    return f"regexp_replace({trimmed}, '\\?(?:, \\?)+', '?', 'g')"


def _shape_key(n: str) -> str:
    exponents = f"regexp_replace({n}, '\\?e(?:[0-9]+\\b|[+-]\\?)', '?', 'g')"
    tight = f"""regexp_replace({exponents}, '("[^"]*(?:""[^"]*)*"?)| ?([(),;=<>+*/.\\[\\]-]) ?', '\\1\\2', 'g')"""
    spelled = tight
    for old, new in ((r" ?!=", "<>"), (r"\binner join\b", "join"), (r"([ )\]])as( |$)", r"\1"), (r"([ )\]])as\(", r"\1(")):
        spelled = f"regexp_replace({spelled}, '{old}', '{new}', 'g')"
    lists = f"regexp_replace({spelled}, '\\?(?:,\\?)+', '?', 'g')"
    whole = f"regexp_replace({lists}, ';+$', '')"
    return f"case when regexp_matches({n}, '^\\(*(?:select|with|from|values)\\b') then {whole} else {n} end"


def _hash(text: str) -> str:
    return f"substr(sha256({text}), 1, 16)"


_NODE = "$.statements[0].node"
_FLAG_LIST = f"""case when json_extract_string(js, '$.error') = 'true' then
    list_filter([case when contains(n, 'select *') then 'select_star' end,
      case when contains(n, ' order by ') and not contains(n, ' limit ') then 'order_without_limit' end], lambda f: f is not null)
  else list_filter([
    case when contains(js, '"class":"STAR"') then 'select_star' end,
    case when contains(js, '"ref_type":"CROSS"') then 'cross_join' end,
    case when json_extract_string(js, '{_NODE}.type') = 'SELECT_NODE'
      and json_extract_string(js, '{_NODE}.from_table.type') <> 'EMPTY'
      and cast(json_extract(js, '{_NODE}.where_clause') as varchar) = 'null' then 'no_filter' end,
    case when json_extract_string(js, '{_NODE}.type') = 'SELECT_NODE'
      and list_contains(json_extract_string(js, '{_NODE}.modifiers[*].type'), 'ORDER_MODIFIER')
      and not list_contains(json_extract_string(js, '{_NODE}.modifiers[*].type'), 'LIMIT_MODIFIER')
      then 'order_without_limit' end], lambda f: f is not null) end"""

_NORMAL = f"nm as materialized (select *, {_normalized('query_text')} as n from ev)"
_STAMPED = f"{_NORMAL}, sk as (select *, {_shape_key('n')} as shape_key from nm), " + (
    f"fe as materialized (select *, {_hash('shape_key')} as fingerprint from sk)"
)


def _first_events(order: str = "start_time, query_id") -> str:
    """CTE sh: one row per shape from its first event in the given order."""
    return f"""
fi as (select * from fe qualify row_number() over (partition by connection_id, fingerprint order by {order}) = 1),
js as (select *, cast(json_serialize_sql(query_text) as varchar) as js from fi),
sh as materialized (select connection_id, fingerprint, n as normalized_sql, query_text as example_sql,
    json_extract_string(js, '$.error') <> 'true' as parsed, {_FLAG_LIST} as flags, start_time as first_seen from js)"""


_TEXT = [_EVENTS, _STAMPED]
_SHAPES = _TEXT + [_first_events()]

_oracle("normalize_statements", [_EVENTS, _NORMAL], "select connection_id, query_id, n as normalized_sql from nm")
_oracle("fingerprints", [_EVENTS, _NORMAL], f"select connection_id, query_id, {_hash('n')} as fingerprint from nm")
_oracle("shape_keys", _TEXT, "select connection_id, query_id, shape_key, fingerprint from fe")
_oracle(
    "statement_flags",
    [_EVENTS, _NORMAL, "j as (select *, cast(json_serialize_sql(query_text) as varchar) as js from nm)"],
    f"select connection_id, query_id, array_to_string({_FLAG_LIST}, ',') as antipatterns from j",
)

# The parse tree without literals and places in the text; equal literals next to each other count once.
_LITERAL = r"""\{"class":"CONSTANT","type":"VALUE_CONSTANT","alias":"","literal":"\?"\}"""
_PLACES = r"""regexp_replace(js, '"query_location(_length)?":[0-9]+,?', '', 'g')"""
_BLANKED = (
    rf"""regexp_replace(regexp_replace({_PLACES}, '"literal":\{{"kind":"[A-Z_]+","text":"([^"\\]|\\.)*"\}}', '"literal":"?"', 'g'), """
    rf"""'({_LITERAL})(,{_LITERAL})+', '\1', 'g')"""
)
_oracle(
    "shape_groups",
    [
        f"ev as ({oracle_text(VARIANTS_SQL)})",
        _NORMAL,
        "j as (select *, cast(json_serialize_sql(query_text) as varchar) as js from nm)",
        f"k as (select query_id, case when json_extract_string(js, '$.error') = 'true' then n else {_BLANKED} end as shape from j)",
    ],
    "select query_id, min(query_id) over (partition by shape) as same_as, count(*) over (partition by shape) as members from k",
)

_PREVIEW = char_class(PREVIEW_SPACE)


def _one_line(text: str) -> str:
    lines = f"string_split({text}, chr(10))"
    strip = f"regexp_replace(l, '^[{_PREVIEW}]+|[{_PREVIEW}]+$', '', 'g')"
    kept = f"list_transform({lines}, lambda l: {strip} <> '' and not starts_with({strip}, '--'))"
    start = f"list_position({kept}, true)"
    body = f"case when {start} is null then {text} else array_to_string({lines}[{start}:], chr(10)) end"
    return f"trim(regexp_replace({body}, '[{_PREVIEW}]+', ' ', 'g'), ' ')"


_oracle(
    "statement_preview", [_EVENTS], f"select connection_id, query_id, {_one_line('query_text')} as preview from ev"
)
_oracle(
    "document_statements",
    [f"d as materialized (select doc_id, text, {_normalized('text')} as n from documents)"],
    f"""select doc_id, {_hash('n')} as fingerprint, length(n) as normalized_length,
  {_hash(_one_line('text'))} as preview_hash,
  case when length(text) > 2000 then substr(text, 1, 2000) || '...' else text end as listed,
  case when length(text) > 2000 then substr(text, 1, 2000) || '...' || chr(10)
    || '-- This query was cut at 2000 characters and is not complete.' else text end as copied
from d""",
)

# Reads ---------------------------------------------------------------------------------------------------------------

_BASE = [_RATES, _EVENTS, _CONNECTIONS]

_oracle(
    "summary",
    _BASE
    + [
        _cells("cells", "1 as one", _MONTH),
        "costs as (select connection_id, sum(cost) as cost from cells group by 1)",
        f"""figures as (select connection_id, count(*) as n, count(error_type) as failures,
  quantile_cont(total_elapsed_time_ms, 0.5) as p50, quantile_cont(total_elapsed_time_ms, 0.95) as p95
  from ev where not is_internal and {_span(_MONTH)} group by 1)""",
    ],
    f"""select connection_id, coalesce(n, 0) as query_count, coalesce(failures, 0) as failure_count,
  {_money('p50', 'p50_ms')}, {_money('p95', 'p95_ms')}, {_money('coalesce(cost, 0)', 'estimated_cost_usd')}
from ti left join figures using (connection_id) left join costs using (connection_id)""",
)
_oracle(
    "summary_by_instance_type",
    _BASE + [_cells("cells", "1 as one", _MONTH)],
    f"""select connection_id, size as instance_type, n as query_count, total_ms, sub_second_count, sub_second_ms,
  {_money('cost', 'estimated_cost_usd')} from cells""",
)


def _grid(bounds: tuple[str, str], seconds: int) -> str:
    return f"""
gr as (select connection_id, unnest(generate_series(timestamp '{bounds[0]}', timestamp '{bounds[1]}',
    interval {seconds} second)) as bucket_start from ti),
gb as (select * from gr where bucket_start < timestamp '{bounds[1]}')"""


_BIN = f"time_bucket(interval {_HALF_DAY} second, start_time, timestamp '{_MONTH[0]}') as bucket_start"
# the chart as the range join it is defined by
_CHART = _BASE + [
    _grid(_MONTH, _HALF_DAY),
    _cells("cells", _BIN, _MONTH),
    "costs as (select connection_id, bucket_start, sum(cost) as cost, sum(n) as n from cells group by 1, 2)",
    f"""chart as (select g.connection_id, g.bucket_start, count(e.query_id) as query_count,
  count(e.query_id) filter (where e.error_type is not null) as failure_count,
  quantile_cont(e.total_elapsed_time_ms, 0.5) as p50, quantile_cont(e.total_elapsed_time_ms, 0.95) as p95
  from gb g left join ev e on e.connection_id = g.connection_id and e.start_time >= g.bucket_start
    and e.start_time < g.bucket_start + interval {_HALF_DAY} second and e.start_time < timestamp '{_MONTH[1]}'
    and not e.is_internal
  group by 1, 2)""",
]
_oracle(
    "latency_buckets",
    _CHART,
    f"""select connection_id, bucket_start, query_count, failure_count, {_money('p50', 'p50_ms')}, {_money('p95', 'p95_ms')},
  {_money('coalesce(cost, 0)', 'estimated_cost_usd')}
from chart left join costs using (connection_id, bucket_start)""",
)
_oracle(
    "cost_buckets",
    _CHART,
    f"""select connection_id, bucket_start, cast(coalesce(n, 0) as bigint) as query_count,
  {_money('coalesce(cost, 0)', 'estimated_cost_usd')} from gb left join costs using (connection_id, bucket_start)""",
)
_oracle(
    "latency_segments",
    _CHART
    + [
        """islands as (select *, row_number() over (partition by connection_id order by bucket_start)
     - dense_rank() over (partition by connection_id, p95 is null order by bucket_start) as island from chart)"""
    ],
    f"""select connection_id, min(bucket_start) as segment_start, max(bucket_start) as segment_end, count(*) as points,
  {_money('max(p95)', 'max_p95_ms')} from islands where p95 is not null group by connection_id, island""",
)
_DIGEST = """connection_id, count(*) as buckets, min(bucket_start) as first_bucket, max(bucket_start) as last_bucket,
  {total} as total, {peak} as peak, min(bucket_start) filter (where v = top) as peak_bucket,
  cast(sum(failure_count) as bigint) as failures, count(*) filter (where n > 0) as populated_buckets"""
_oracle(
    "chart_digest",
    _CHART
    + [
        """top as (select *, query_count as v, query_count as n, max(query_count) over (partition by connection_id) as top
     from chart)"""
    ],
    "select " + _DIGEST.format(total="cast(sum(v) as bigint)", peak="max(v)") + " from top group by 1",
)
_oracle(
    "chart_digest_cost",
    _CHART
    + [
        """spent as (select connection_id, bucket_start, 0 as failure_count, coalesce(n, 0) as n, coalesce(cost, 0) as v
     from gb left join costs using (connection_id, bucket_start))""",
        "top as (select *, max(v) over (partition by connection_id) as top from spent)",
    ],
    "select "
    + _DIGEST.format(total="round(sum(v) + 1e-9, 6)", peak="round(max(v) + 1e-9, 6)")
    + " from top group by 1",
)


def _attribution(column: str) -> tuple[list[str], str]:
    key = f"coalesce({column}, 'unknown') as key"
    ctes = _BASE + [
        _cells("cur", key, _HALF),
        _cells("old", key, _BEFORE),
        """c as (select connection_id, key, sum(n) as n, sum(failures) as failures, sum(total_ms) as total_ms,
     sum(cost) as cost from cur group by 1, 2)""",
        "p as (select connection_id, key, sum(cost) as cost from old group by 1, 2)",
        "t as (select connection_id, sum(cost) as total from c group by 1)",
    ]
    body = f"""select connection_id, key, cast(n as bigint) as query_count, cast(failures as bigint) as failure_count,
  cast(total_ms as bigint) as total_ms, {_money('c.cost', 'estimated_cost_usd')},
  {_money('case when total > 0 then c.cost / total else 0 end', 'cost_share')},
  {_money('coalesce(p.cost, 0)', 'previous_cost_usd')},
  {_money('case when coalesce(p.cost, 0) >= 0.01 then (c.cost - p.cost) / p.cost * 100 end', 'change_pct')}
from c left join p using (connection_id, key) join t using (connection_id)"""
    return ctes, body


_oracle("attribution_by_user", *_attribution("user_name"))
_oracle("attribution_by_instance_type", *_attribution("instance_type"))
_oracle(
    "attribution_totals",
    _attribution("user_name")[0] + ["pt as (select connection_id, sum(cost) as before from p group by 1)",
     "tt as (select connection_id, sum(total_ms) as total_ms from c group by 1)"],
    f"""select connection_id, {_money('coalesce(total, 0)', 'estimated_cost_usd')},
  {_money('coalesce(before, 0)', 'previous_cost_usd')}, cast(coalesce(total_ms, 0) as bigint) as total_ms
from ti left join t using (connection_id) left join pt using (connection_id) left join tt using (connection_id)""",
)

_RUN_COST = f"""case when lower(trim(instance_type)) = 'pulse' then greatest(coalesce({_BILLED}, 0), 1000)
  when {_BILLED} is not null then greatest({_BILLED}, 0) end / 1000.0 / 3600.0 * usd"""
_PRICED = f"""
pr as (select e.*, {_RUN_COST} as cost from ev e join ti using (connection_id)
  left join rt on rt.tier = ti.tier and rt.size = lower(trim(e.instance_type)))"""
_EVENT_COLUMNS = """connection_id, query_id, query_text, query_type, start_time, end_time, execution_time_ms, wait_time_ms,
  total_elapsed_time_ms, error_type, error_message, user_name, instance_type, worker_id, session_name, bytes_uploaded,
  bytes_downloaded, bytes_spilled_to_disk, user_agent, is_internal"""
_oracle(
    "event_costs",
    _BASE + [_PRICED],
    f"select connection_id, query_id, instance_type, {_money('cost', 'estimated_cost_usd')} from pr",
)


def _listed(kept: str, order: str, limit: int) -> str:
    return f"""
li as (select * from pr where not is_internal and {_span(_MONTH)} and {kept}
  qualify row_number() over (partition by connection_id order by {order}, query_id) <= {limit})"""


_LIST = f"""select {_EVENT_COLUMNS}, {_NOW} as ingested_at, {_money('cost', 'estimated_cost_usd')}"""
_SLOW = _listed("total_elapsed_time_ms is not null", "total_elapsed_time_ms desc", 20)
_oracle("slow_queries", _BASE + [_PRICED, _SLOW], _LIST + ", false as is_cut from li")
_oracle(
    "slow_queries_oldest",
    _BASE + [_PRICED, _listed("total_elapsed_time_ms is not null", "start_time asc", 500)],
    _LIST + ", false as is_cut from li",
)
_oracle(
    "recent_failures",
    _BASE + [_PRICED, _listed("error_type is not null", "start_time desc", 20)],
    _LIST + ", false as is_cut from li",
)
_oracle("event_detail", _BASE + [_PRICED, _SLOW], _LIST + " from li")
_oracle(
    "filter_values",
    [_EVENTS],
    f"""select distinct connection_id, 'user_name' as kind, user_name as value from ev
  where user_name is not null and {_span(_MONTH)}
union all select distinct connection_id, 'query_type', query_type from ev where query_type is not null and {_span(_MONTH)}""",
)
_oracle(
    "search_events",
    [_EVENTS],
    f"""select connection_id, query_id, query_text from ev
where not is_internal and {_span(_MONTH)} and query_text ilike '%from clicks\\_1%' escape '\\'""",
)
_oracle(
    "filtered_events",
    [_EVENTS],
    """select connection_id, query_id, start_time, total_elapsed_time_ms from ev
where start_time >= timestamp '2024-01-08' and start_time < timestamp '2024-01-29' and user_name = 'user_7'
  and query_type = 'QUERY' and total_elapsed_time_ms >= 1000""",
)
_oracle(
    "shape_runs",
    _TEXT,
    f"""select connection_id, query_id, fingerprint from fe
where not is_internal and {_span(_MONTH)} and fingerprint = {_hash(f"'{VIEW_SHAPE}'")}""",
)
_oracle("internal_traffic", [_EVENTS], "select connection_id, query_id, is_internal from ev")

# Shapes and findings -------------------------------------------------------------------------------------------------

_FIGURES = _BASE + [
    _STAMPED,
    _first_events(),
    _cells(
        "cells",
        "fingerprint",
        _MONTH,
        "max(total_elapsed_time_ms) as max_ms, sum(bytes_spilled_to_disk) as spilled, max(start_time) as last_seen,",
        source="fe",
    ),
    """fo as (select connection_id, fingerprint, cast(sum(n) as bigint) as runs, cast(sum(failures) as bigint) as failure_count,
     cast(sum(total_ms) as bigint) as total_ms, greatest(coalesce(max(max_ms), 0), 0) as max_ms,
     cast(coalesce(sum(spilled), 0) as bigint) as bytes_spilled, sum(cost) as cost, max(last_seen) as last_seen
     from cells group by 1, 2)""",
    """fg as materialized (select fo.*, case when sum(cost) over (partition by connection_id) > 0
     then cost / sum(cost) over (partition by connection_id) else 0 end as share, sh.example_sql, sh.flags
     from fo left join sh using (connection_id, fingerprint))""",
]
_FOUND = _FIGURES + [
    """fd as (select fg.*, unnest(list_concat(
       case when bytes_spilled >= 1000000000 then ['spilling'] else [] end,
       case when cost >= 0.1 and runs >= 50 and share >= 0.02 then ['repeated_runs'] else [] end,
       case when cost >= 0.1 and share >= 0.01 then flags else [] end)) as antipattern from fg)"""
]
_FIGURE_COLUMNS = f"""connection_id, fingerprint, runs, failure_count, total_ms, bytes_spilled, last_seen,
  {_money('cost', 'estimated_cost_usd')}, {_money('share', 'cost_share')}"""
_oracle(
    "shapes",
    _FIGURES,
    f"""select {_FIGURE_COLUMNS}, max_ms, array_to_string(flags, ',') as antipatterns, example_sql, false as is_cut,
  example_sql as copy_sql from fg
qualify row_number() over (partition by connection_id order by round(cost, 12) desc, runs desc, fingerprint) <= 20""",
)
_oracle(
    "insights",
    _FOUND,
    f"""select {_FIGURE_COLUMNS}, antipattern, example_sql, false as is_cut from fd
qualify row_number() over (partition by connection_id order by round(cost, 12) desc, fingerprint, antipattern) <= 20""",
)
_oracle(
    "insight_totals",
    _FOUND,
    f"""select connection_id, antipattern, count(*) as shapes, {_money('sum(cost)', 'estimated_cost_usd')},
  cast(sum(count(*)) over (partition by connection_id) as bigint) as total from fd group by 1, 2""",
)
_oracle(
    "insights_by_shape",
    _FOUND,
    f"""select connection_id, fingerprint, string_agg(antipattern, ',' order by antipattern) as reasons,
  {_money('any_value(cost)', 'estimated_cost_usd')}, {_money('any_value(share)', 'cost_share')}, any_value(runs) as runs,
  any_value(bytes_spilled) as bytes_spilled, any_value(last_seen) as last_seen from fd group by 1, 2""",
)
_oracle(
    "shape_statement",
    _FOUND,
    """select connection_id, fingerprint, example_sql, parsed, first_seen from sh
where (connection_id, fingerprint) in (select (connection_id, fingerprint) from fd)""",
)
_SHAPE_ROW = """connection_id, fingerprint, normalized_sql, example_sql, parsed, array_to_string(flags, ',') as antipatterns,
  first_seen"""
_oracle(
    "shape_registry",
    _TEXT + [_first_events("start_time < timestamp '2024-01-16', start_time, query_id")],
    f"select {_SHAPE_ROW} from sh",
)
_oracle(
    "pending_flags",
    _SHAPES,
    """select connection_id, fingerprint, example_sql, first_seen from sh where first_seen >= timestamp '2024-01-16'""",
)
_oracle(
    "flag_backfill",
    _SHAPES
    + [
        """pf as (select connection_id, fingerprint from sh where first_seen >= timestamp '2024-01-16')"""
    ],
    """select connection_id, fingerprint, case when first_seen < timestamp '2024-01-16' or
  (connection_id, fingerprint) in (select (connection_id, fingerprint) from pf) then array_to_string(flags, ',') end
  as antipatterns from sh""",
)
_PENDING = """
pe as (select connection_id, query_id, query_text, start_time from ev)"""
_oracle("pending_fingerprints", [_EVENTS, _PENDING], "select * from pe")
_oracle(
    "fingerprint_backfill",
    _TEXT + [_PENDING],
    """select fe.connection_id, fe.query_id, case when pe.query_id is not null then fe.fingerprint end as fingerprint
from fe left join pe on pe.connection_id = fe.connection_id and pe.query_id = fe.query_id""",
)

# Sources and merges --------------------------------------------------------------------------------------------------

_HEX = "[0-9a-fA-F]"
_HYPHENATED = f"{_HEX}{{8}}(?:-{_HEX}{{4}}){{3}}-{_HEX}{{12}}"
_READABLE = (
    f"regexp_full_match(query_id, '{_HEX}{{32}}|(?:urn:uuid:)?{_HYPHENATED}|\\{{{_HYPHENATED}\\}}')"
    " and start_ms between -8334601228800000 and 8210266876799999"
)
_DRAFTS = f"""
dr as (select connection_id,
    regexp_replace(regexp_replace(lower(query_id), 'urn:uuid:|[^0-9a-f]', '', 'g'),
      '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') as query_id,
    query_text, query_type, epoch_ms(start_ms) as start_time,
    case when end_ms <= 8210266876799999 then epoch_ms(end_ms) end as end_time, execution_time_ms, wait_time_ms,
    total_elapsed_time_ms, error_type, error_message, user_name, instance_type, worker_id, session_name, bytes_uploaded,
    bytes_downloaded, bytes_spilled_to_disk, user_agent
  from hi where {_READABLE})"""
_INTERNAL = "coalesce(contains(lower(user_agent), 'selfwatch'), false) or contains(query_text, '-- selfwatch')"

_oracle("readable_rows", [_HISTORY, _DRAFTS], "select * from dr")
_oracle(
    "normalized_events",
    [_HISTORY, _DRAFTS],
    f"select *, {_INTERNAL} as is_internal, {_NOW} as ingested_at from dr",
)
_oracle(
    "unreadable_counts",
    [_HISTORY],
    f"""select connection_id, count(*) as rows_returned, count(*) filter (where not ({_READABLE})) as unreadable
from hi group by 1""",
)
_oracle("storage_scan", [_STORAGE], f"select *, {_NOW} as ingested_at from st")
_oracle(
    "storage_append",
    [_STORAGE],
    f"""select connection_id, database_name, computed_at,
  case when computed_at < timestamp '1998-01-01' then active_bytes else active_bytes + 1 end as active_bytes,
  historical_bytes, retained_for_clone_bytes, failsafe_bytes, {_NOW} as ingested_at from st""",
)
_LATEST = """
la as (select *, active_bytes + historical_bytes + retained_for_clone_bytes + failsafe_bytes as total from st
  qualify row_number() over (partition by connection_id, database_name order by computed_at desc) = 1)"""
_oracle(
    "storage_latest",
    [_STORAGE, _LATEST],
    f"""select connection_id, database_name, computed_at, active_bytes, historical_bytes, retained_for_clone_bytes,
  failsafe_bytes, {_NOW} as ingested_at from la""",
)
_HELD = [
    _RATES,
    _CONNECTIONS,
    _STORAGE,
    _LATEST,
    """he as (select la.*, greatest(total, 0) / 1e9 * gb as cost from la join ti using (connection_id)
     join (select distinct tier, gb from rt) g using (tier))""",
]
_oracle(
    "storage_by_database",
    _HELD,
    f"""select connection_id, database_name, active_bytes, historical_bytes, retained_for_clone_bytes, failsafe_bytes,
  total as total_bytes, {_money('cost', 'estimated_monthly_cost_usd')}, computed_at from he""",
)
_oracle(
    "storage_summary",
    _HELD,
    f"""select connection_id, cast(coalesce(sum(total), 0) as bigint) as total_bytes,
  {_money('coalesce(sum(cost), 0)', 'estimated_monthly_cost_usd')}, max(computed_at) as computed_at
from ti left join he using (connection_id) group by 1""",
)


def _delivered(name: str) -> str:
    """One column of the event table after both deliveries."""
    first, again = f"f.{name}", f"a.{name}"
    if name in ("query_text", "start_time"):
        return f"case when f.query_id is not null then {first} else {again} end as {name}"
    if name in ("query_type", "user_name", "instance_type", "worker_id", "session_name", "bytes_uploaded",
                "bytes_downloaded", "bytes_spilled_to_disk", "fingerprint"):
        return f"coalesce({again}, {first}) as {name}"
    return f"case when a.query_id is not null then {again} else {first} end as {name}"


_DELIVERED = [
    _EVENTS,
    """f as (select * replace (cast(null as timestamp) as end_time, cast(null as bigint) as total_elapsed_time_ms,
      cast(null as bigint) as bytes_spilled_to_disk, cast(null as varchar) as user_agent, false as is_internal),
      '0123456789abcdef' as fingerprint, timestamp '2024-01-29' as ingested_at
    from ev where start_time < timestamp '2024-01-29')""",
    f"""a as (select * replace (case when bytes_downloaded % 200 = 0 then user_name end as user_name,
      concat('changed ', query_text) as query_text), cast(null as varchar) as fingerprint, {_NOW} as ingested_at
    from ev where start_time >= timestamp '2024-01-08')""",
]
_MERGED_COLUMNS = [
    "query_text", "query_type", "start_time", "end_time", "execution_time_ms", "wait_time_ms", "total_elapsed_time_ms",
    "error_type", "error_message", "user_name", "instance_type", "worker_id", "session_name", "bytes_uploaded",
    "bytes_downloaded", "bytes_spilled_to_disk", "user_agent", "is_internal", "fingerprint", "ingested_at",
]
for _name in ("event_upsert", "event_fold", "event_upsert_one_batch", "event_upsert_stored", "event_upsert_moved"):
    _oracle(
        _name,
        _DELIVERED,
        "select connection_id, query_id, "
        + ", ".join(map(_delivered, _MERGED_COLUMNS))
        + " from f full join a using (connection_id, query_id)",
    )
_oracle(
    "purge_connection",
    [_EVENTS, _CONNECTIONS],
    """select connection_id, query_id, start_time from ev
where connection_id not in (select id from cn where not enabled)""",
)

# Ingest bookkeeping --------------------------------------------------------------------------------------------------

_PLAN = """
pl as (select id as connection_id, watermark_start_time, catching_up, case when catching_up then watermark_start_time
    else watermark_start_time - interval 15 minute end as since from cn where enabled)"""
_PAGED = f"""
pg as (select hi.* from hi join pl using (connection_id) where since is null or start_ms >= epoch_ms(since)
  qualify row_number() over (partition by connection_id order by start_ms, query_id) <= {PAGE})"""
_STATS = f"""
sa as (select connection_id, count(*) as returned, count(*) filter (where not ({_READABLE})) as lost,
    max(case when {_READABLE} then epoch_ms(start_ms) end) as newest from pg group by 1),
ou as (select connection_id, watermark_start_time as mark, catching_up as was_catching_up,
    coalesce(returned, 0) as returned, coalesce(lost, 0) as lost, greatest(watermark_start_time, newest) as advanced,
    coalesce(returned, 0) >= {PAGE} as filled from pl left join sa using (connection_id)),
oc as (select *, was_catching_up and filled and advanced is not distinct from mark as stalled from ou)"""
_OUTCOME = f"""
so as (select connection_id, advanced as watermark_start_time, filled as catching_up, returned as rows_returned,
    lost as unreadable, not stalled as succeeded,
    case when stalled and lost > 0 then lost || ' unreadable rows block the way past the watermark'
      when stalled then 'over {PAGE} runs start at one instant; raise the batch limit' end as sync_error,
    case when not stalled and lost > 0 then lost || ' unreadable rows were skipped' end as ingest_warning from oc)"""
_oracle("fetch_plan", [_CONNECTIONS, _PLAN], "select * from pl")
_oracle(
    "history_page",
    [_HISTORY, _CONNECTIONS, _PLAN, _PAGED],
    "select connection_id, query_id, start_ms, query_text, execution_time_ms from pg",
)
_oracle(
    "advance_watermark",
    [_HISTORY, _DRAFTS, _CONNECTIONS],
    """select id as connection_id, greatest(max(watermark_start_time), max(start_time)) as watermark_start_time
from cn left join dr on dr.connection_id = cn.id group by 1""",
)
_PASS = [_HISTORY, _CONNECTIONS, _PLAN, _PAGED, _STATS, _OUTCOME]
_oracle("sync_outcome", _PASS, "select * from so")
_STATE = f"""select id, name, region_tier, enabled,
  case when so.connection_id is null then cn.watermark_start_time else so.watermark_start_time end as watermark_start_time,
  case when so.connection_id is null then last_synced_at else {_NOW} end as last_synced_at,
  case when succeeded then {_NOW} else last_success_at end as last_success_at,
  case when so.connection_id is null then last_sync_error else sync_error end as last_sync_error,
  coalesce(ingest_warning, last_ingest_warning) as last_ingest_warning, created_at,
  case when so.connection_id is null then updated_at else {_NOW} end as updated_at,
  case when so.connection_id is null then cn.catching_up else so.catching_up end as catching_up, storage_attempted_at
from cn left join so on so.connection_id = cn.id"""
_oracle("sync_state", _PASS, _STATE)


def _changed(ctes: str, old: str, new: str) -> str:
    """A building block with one CTE renamed, so that another can take its name."""
    if f"{old} as (" not in ctes:
        raise ValueError(old)
    return ctes.replace(f"{old} as (", f"{new} as (")


# One connection at a standstill, some that fail to be read.
_oracle(
    "ingest_pass",
    [
        _changed(_HISTORY, "hi", "hi0"),
        f"""hi as (select * replace (case when connection_id = '{HOT}' then epoch_ms(timestamp '2024-01-16') else start_ms end
      as start_ms) from hi0)""",
        _changed(_CONNECTIONS.split(",\nti as")[0], "cn", "cn0"),
        f"cn as (select * replace (catching_up or id = '{HOT}' as catching_up) from cn0)",
        _PLAN,
        _PAGED,
        _STATS,
        _changed(_OUTCOME, "so", "so0"),
        "fl as (select id from cn where enabled and suffix(id, '3'))",
        """so as (select so0.connection_id, case when fl.id is null then so0.watermark_start_time else pl.watermark_start_time end
        as watermark_start_time, case when fl.id is null then so0.catching_up else pl.catching_up end as catching_up,
      fl.id is null and succeeded as succeeded, case when fl.id is null then sync_error else 'no route' end as sync_error,
      case when fl.id is null then ingest_warning end as ingest_warning
    from so0 join pl using (connection_id) left join fl on fl.id = so0.connection_id)""",
        f"sn as ({_STATE})",
        f"""es as (select connection_id as id, count(*) as events_stored from pg
    where {_READABLE} and connection_id not in (select id from fl) group by 1)""",
        _STORAGE,
        f"du as (select id from cn where enabled and (storage_attempted_at is null or {_NOW} - storage_attempted_at >= interval 3600 second))",
        "sx as (select connection_id as id, count(*) as samples_stored from st where connection_id in (select id from du) group by 1)",
    ],
    f"""select sn.* replace (case when du.id is null then storage_attempted_at else {_NOW} end as storage_attempted_at),
  coalesce(events_stored, 0) as events_stored, coalesce(samples_stored, 0) as samples_stored
from sn left join es using (id) left join sx using (id) left join du using (id)""",
)
_oracle(
    "storage_due",
    [_CONNECTIONS],
    f"""select id as connection_id from cn
where enabled and (storage_attempted_at is null or {_NOW} - storage_attempted_at >= interval 3600 second)""",
)


def _age(column: str) -> str:
    return f"cast(greatest(floor((epoch_us({_NOW}) - epoch_us({column})) / 1e6), 0) as bigint)"


_oracle(
    "ingestion_health",
    [
        _CONNECTIONS,
        f"""ag as (select *, case when last_success_at is not null then {_age('last_success_at')} end as since,
      case when watermark_start_time is not null then {_age('watermark_start_time')} end as behind from cn)""",
        """hs as (select *, case when not enabled then 'disabled' when last_sync_error is not null then 'failing'
      when last_success_at is null then case when last_synced_at is null then 'pending' else 'stale' end
      when since > 18000 then 'stale' else 'healthy' end as health from ag)""",
    ],
    """select * exclude (since, behind, health), health, since as seconds_since_success, behind as seconds_behind,
  cast(18000 as bigint) as stale_after_seconds,
  case health when 'healthy' then case when last_ingest_warning is not null then 'warn' else 'ok' end
    when 'stale' then 'warn' when 'failing' then 'danger' else 'neutral' end as tone
from hs""",
)

# Streams end where the batch ends ------------------------------------------------------------------------------------

_oracle(
    "stream_upsert",
    [
        _HISTORY,
        _DRAFTS,
        f"ev as (select *, {_INTERNAL} as is_internal from dr)",
        _STAMPED,
    ],
    f"""select {_EVENT_COLUMNS}, fingerprint, {_NOW} as ingested_at from fe""",
)
_oracle(
    "stream_latency",
    [_HISTORY, _DRAFTS, f"ev as (select *, {_INTERNAL} as is_internal from dr)"],
    f"""select connection_id, time_bucket(interval 6 hour, start_time) as window_start,
  {_money('quantile_cont(total_elapsed_time_ms, 0.5)', 'p50_ms')},
  {_money('quantile_cont(total_elapsed_time_ms, 0.95)', 'p95_ms')},
  count(*) as query_count, count(error_type) as failure_count
from ev where not is_internal group by 1, 2""",
)

_oracle(
    "stream_sync_state",
    [
        _HISTORY,
        _CONNECTIONS,
        f"""sa as (select connection_id as id, count(*) filter (where not ({_READABLE})) as lost,
      max(case when {_READABLE} then epoch_ms(start_ms) end) as newest from hi group by 1)""",
    ],
    f"""select id, name, region_tier, enabled,
  case when enabled and sa.id is not null then greatest(watermark_start_time, newest) else watermark_start_time end
    as watermark_start_time,
  case when enabled and sa.id is not null then {_NOW} else last_synced_at end as last_synced_at,
  case when enabled and sa.id is not null then {_NOW} else last_success_at end as last_success_at,
  case when enabled and sa.id is not null then null else last_sync_error end as last_sync_error,
  case when (enabled and coalesce(lost, 0) > 0) or contains(last_ingest_warning, 'skipped') then 'skipped' end as last_ingest_warning,
  created_at, case when enabled and sa.id is not null then {_NOW} else updated_at end as updated_at,
  case when enabled and sa.id is not null then false else catching_up end as catching_up, storage_attempted_at
from cn left join sa using (id)""",
)

# Reads of one connection are the rows of that connection -------------------------------------------------------------

for _name in (
    "summary summary_by_instance_type latency_buckets cost_buckets attribution_by_user attribution_by_instance_type "
    "attribution_totals slow_queries recent_failures shapes insights insight_totals insights_by_shape filter_values "
    "search_events latency_segments chart_digest"
).split():
    _REGISTRY[f"{_name}_of_one"] = f"select * from ({_REGISTRY[_name]}) o where connection_id = '{HOT}'"

for _name, _same in (
    ("summary_from_cells", "summary"),
    ("summary_by_instance_type_from_cells", "summary_by_instance_type"),
    ("attribution_from_cells", "attribution_by_user"),
    ("shapes_from_cells", "shapes"),
):
    _REGISTRY[_name] = _REGISTRY[_same]

_oracle(
    "history_drained",
    [
        _changed(_HISTORY, "hi", "hi0"),
        """hi as (select * replace (case when suffix(connection_id, '7') then epoch_ms(timestamp '2024-01-16') else start_ms end
      as start_ms) from hi0)""",
        _CONNECTIONS,
        _PLAN,
    ],
    """select connection_id, query_id, start_ms, query_text, execution_time_ms
from hi join pl using (connection_id) where since is null or start_ms >= epoch_ms(since)""",
)
_oracle(
    "event_lookup", [_EVENTS], f"select {_EVENT_COLUMNS}, {_NOW} as ingested_at from ev where starts_with(query_id, '00')"
)
