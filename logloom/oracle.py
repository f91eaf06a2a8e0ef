"""DuckDB statements equal to the named queries of ``logloom.contract``.

They derive the logs from ``events`` with the same rules, written independently in SQL, and
parse the access lines with DuckDB's own regex engine. Sums are cast to BIGINT (DuckDB sums
to HUGEINT). Orderings repeat the Spark tie-breaks, with explicit NULL placement.
"""

from __future__ import annotations

from logloom import contract, schemas
from logloom.contract import AS_OF, BATCH_ID, INGEST_TS
from logloom.functions.access import (
    ACCESS_LINE_PATTERN,
    ACCESS_LINE_PATTERN_DASH_SIZE,
    ACCESS_TABLE_PATTERN,
)

EVENTS_CTE = """ev AS (
  SELECT event_id AS eid, user_id AS uid, event_type, ts, props,
         regexp_extract(props, '"k": ([0-9]+)', 1) AS k
  FROM events
)"""

LOGS_CTE = EVENTS_CTE + """,
logs AS (
  SELECT ts AS "timestamp",
         CAST(ts AS DATE) AS partition_date,
         CAST(ts AS DATE) AS date_partition,
         CASE WHEN event_type = 'error' AND eid % 10 = 0 THEN 'FATAL'
              WHEN event_type = 'error' THEN 'ERROR'
              WHEN event_type = 'signup' THEN 'WARN'
              WHEN event_type = 'view' THEN 'DEBUG'
              ELSE 'INFO' END AS level,
         event_type || ' k=' || k AS message,
         'svc.' || event_type || '.' || CAST(uid % 7 AS VARCHAR) AS logger,
         'svc-' || CAST(uid % 7 AS VARCHAR) AS source,
         CASE WHEN event_type = 'error' AND eid % 3 <> 0
              THEN 'Err' || CAST(TRY_CAST(k AS INTEGER) % 5 AS VARCHAR) END AS exception_class,
         CASE WHEN event_type = 'error' AND eid % 3 = 1
              THEN 'code ' || CAST(TRY_CAST(k AS INTEGER) % 4 AS VARCHAR) END AS exception_message,
         CASE WHEN eid % 20 <> 0 THEN 'user_' || CAST(uid AS VARCHAR) END AS user_id,
         CAST(uid AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id,
         CASE WHEN eid % 25 <> 0
              THEN '10.0.' || CAST(uid % 16 AS VARCHAR) || '.' || CAST(uid % 251 AS VARCHAR) END AS ip_address,
         eid, props
  FROM ev
)"""

# Application-log records of the JSON lines, by the rules for odd lines (eid % 50): no or null time is
# the ingest time, an unreadable one NULL (its row in the ingest day), a number that does not fit 0;
# blank lines are skipped; text, null and arrays are set aside.
JSON_CTES = LOGS_CTE + f""",
json_logs AS (
  SELECT CASE WHEN eid % 50 IN (11, 13) THEN TIMESTAMP '{INGEST_TS}' WHEN eid % 50 <> 17
              THEN date_trunc('millisecond', "timestamp") END AS "timestamp",
         COALESCE(level, 'INFO') AS level,
         COALESCE(message, '') AS message,
         COALESCE(logger, 'unknown') AS logger,
         COALESCE('worker-' || source, 'main') AS thread,
         COALESCE(source || '.py', '') AS source_file,
         CASE WHEN eid % 50 = 23 THEN 0 ELSE COALESCE(CAST(length(message) AS INTEGER), 0) END AS line_number,
         exception_class, exception_message,
         TIMESTAMP '{INGEST_TS}' AS ingestion_timestamp,
         CASE WHEN eid % 50 IN (11, 13, 17) THEN DATE '{INGEST_TS[:10]}' ELSE CAST("timestamp" AS DATE) END AS partition_date,
         CAST(NULL AS VARCHAR) AS ip_address, CAST(NULL AS VARCHAR) AS http_method,
         CAST(NULL AS VARCHAR) AS http_path, CAST(0 AS INTEGER) AS http_status,
         CAST(0 AS INTEGER) AS response_size, CAST(NULL AS VARCHAR) AS referer,
         CAST(NULL AS VARCHAR) AS user_agent
  FROM logs WHERE eid % 50 NOT IN (0, 37, 41, 43)
),
json_bad AS (
  SELECT 'json' AS format,
         CASE eid % 50 WHEN 0 THEN 'garbage line' WHEN 41 THEN 'null' ELSE '[{{"level": "ERROR"}}]' END AS value,
         'corrupt_json' AS reason
  FROM logs WHERE eid % 50 IN (0, 41, 43)
),
stream_logs AS (
  SELECT j."timestamp", j.level, j.message, j.logger, j.thread, j.partition_date FROM json_logs j
)"""

LINES_CTE = EVENTS_CTE + """,
lines AS (
  SELECT CASE WHEN eid % 50 = 0 THEN 'garbage line' ELSE
         '10.0.0.' || CAST(uid % 251 AS VARCHAR) || ' - - ['
         || CASE eid % 50 WHEN 3 THEN '32/Jan/2024:10:00:00 +0000'
                 WHEN 21 THEN strftime(ts + INTERVAL 330 MINUTE, '%d/%b/%Y:%H:%M:%S') || ' +0530'
                 ELSE strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000' END || '] "'
         || CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END
         || ' /' || event_type || '/' || k || ' HTTP/1.1" '
         || CASE WHEN event_type = 'error' AND eid % 2 = 0 THEN '500' WHEN event_type = 'error' THEN '404' ELSE '200' END
         || ' ' || CASE WHEN eid % 50 = 9 THEN '99999999999' WHEN eid % 30 = 1 THEN '-' ELSE CAST(TRY_CAST(k AS INTEGER) * 17 AS VARCHAR) END
         || ' "-" "ua/' || k || '"' END AS value
  FROM ev
)"""


def _access_ctes(pattern: str) -> str:
    p = "^" + pattern
    groups = ["g_ip", "g_time", "g_method", "g_path", "g_status", "g_size", "g_ref", "g_agent"]
    extracts = ",\n         ".join(f"regexp_extract(value, '{p}', {i + 1}) AS {g}" for i, g in enumerate(groups))
    return LINES_CTE + f""",
acc0 AS (
  SELECT value, regexp_matches(value, '{p}') AS ok,
         {extracts}
  FROM lines
),
acc AS (
  SELECT *, timezone('UTC', try_strptime(g_time, '%d/%b/%Y:%H:%M:%S %z')) AS t,
         TRY_CAST(g_status AS INTEGER) AS st,
         CASE WHEN g_size = '-' THEN 0 ELSE TRY_CAST(g_size AS INTEGER) END AS sz
  FROM acc0
),
access_logs AS (
  SELECT t AS "timestamp",
         CASE WHEN st >= 500 THEN 'ERROR' WHEN st >= 400 THEN 'WARN' ELSE 'INFO' END AS level,
         g_method || ' ' || g_path || ' - ' || g_status AS message,
         'apache.access' AS logger, 'http-worker' AS thread, 'access.log' AS source_file,
         CAST(0 AS INTEGER) AS line_number,
         CASE WHEN st >= 400 THEN 'HttpError' END AS exception_class,
         CASE WHEN st >= 400 THEN 'HTTP ' || g_status END AS exception_message,
         TIMESTAMP '{INGEST_TS}' AS ingestion_timestamp,
         CAST(t AS DATE) AS partition_date,
         g_ip AS ip_address, g_method AS http_method, g_path AS http_path,
         st AS http_status, sz AS response_size,
         NULLIF(g_ref, '-') AS referer, NULLIF(g_agent, '-') AS user_agent
  FROM acc WHERE ok AND t IS NOT NULL AND st IS NOT NULL AND sz IS NOT NULL
),
access_bad AS (
  SELECT 'access' AS format, value,
         CASE WHEN NOT ok THEN 'no_match' WHEN t IS NULL THEN 'bad_timestamp'
              ELSE 'number_out_of_range' END AS reason
  FROM acc WHERE NOT ok OR t IS NULL OR st IS NULL OR sz IS NULL
)"""


ACCESS_CTES = _access_ctes(ACCESS_LINE_PATTERN)
# JSON and access CTEs together (the events CTE once).
MIXED_CTES = JSON_CTES + "," + ACCESS_CTES.removeprefix(EVENTS_CTE + ",")
ACCESS_CTES_DASH = _access_ctes(ACCESS_LINE_PATTERN_DASH_SIZE)

_LOG_COLS = '"timestamp", level, message, logger, source, user_id, session_id, ip_address'
_SERVICE_ROW_COLS = _LOG_COLS.replace("logger, ", "")
_LOG_ORDER_REST = ", ".join(f"{c} ASC NULLS FIRST" for c in _LOG_COLS.split(", ")[1:])


def _access_table_sql() -> str:
    p = "^" + ACCESS_TABLE_PATTERN
    names = ["ip", "ident", "usr", "tm", "method", "url", "protocol", "status", "size", "ref", "agent"]
    name_list = ", ".join(f"'{n}'" for n in names)
    return f"""WITH {LINES_CTE},
a0 AS (SELECT regexp_matches(value, '{p}') AS ok, unnest(regexp_extract(value, '{p}', [{name_list}]))
       FROM lines),
a1 AS (SELECT *, timezone('UTC', try_strptime(tm, '%d/%b/%Y:%H:%M:%S %z')) AS t,
              TRY_CAST(status AS INTEGER) AS st,
              CASE WHEN size = '-' THEN 0 ELSE TRY_CAST(size AS INTEGER) END AS sz
       FROM a0 WHERE ok)
SELECT t AS "timestamp", ip AS remote_ip, NULLIF(usr, '-') AS remote_user, method, url, protocol,
       st AS status, sz AS size, NULLIF(ref, '-') AS referer, NULLIF(agent, '-') AS user_agent,
       CAST(year(t) AS INTEGER) AS year, CAST(month(t) AS INTEGER) AS month,
       CAST(day(t) AS INTEGER) AS day, CAST(hour(t) AS INTEGER) AS hour
FROM a1 WHERE t IS NOT NULL AND st IS NOT NULL AND sz IS NOT NULL"""


def _contents(spec: dict, queries: dict[str, str], direct: dict[str, str]) -> str:
    """(table_name, item, n, m, first, latest) of the direct queries that the summary tables store."""
    parts = []
    for table, (keys, n, m, first, latest) in spec.items():
        item = " || '|' || ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys)
        body = direct[queries[table]].split(f"WITH {LOGS_CTE}\n", 1)[1]
        times = ", ".join(f'CAST({t or "NULL"} AS TIMESTAMP) AS "{alias}"' for t, alias in ((first, "first"), (latest, "latest")))
        parts.append(f"SELECT '{table}' AS table_name, {item} AS item, CAST({n} AS BIGINT) AS n, CAST({m or 0} AS BIGINT) AS m, {times} FROM ({body}) q")
    return f"WITH {LOGS_CTE}\n" + "\nUNION ALL ".join(parts)


_APP_COLS = (
    '"timestamp", level, message, logger, thread, source_file, line_number, exception_class, exception_message, '
    "ingestion_timestamp, partition_date, ip_address, http_method, http_path, http_status, response_size, referer, "
    "user_agent"
)


def _statements() -> dict[str, str]:
    L = f"WITH {LOGS_CTE}\n"
    A = f"WITH {ACCESS_CTES}\n"
    AD = f"WITH {ACCESS_CTES_DASH}\n"
    return {
        "top_errors_by_logger": L + """SELECT level, logger, message, count(*) AS error_count,
  max("timestamp") AS latest_occurrence, min("timestamp") AS first_occurrence
FROM logs WHERE level IN ('ERROR', 'WARN') GROUP BY level, logger, message
ORDER BY error_count DESC, level ASC NULLS FIRST, logger ASC NULLS FIRST, message ASC NULLS FIRST LIMIT 100""",
        "top_errors_by_source": L + """SELECT level, source, message, count(*) AS error_count,
  max("timestamp") AS latest_occurrence, min("timestamp") AS first_occurrence
FROM logs WHERE level IN ('ERROR', 'WARN') GROUP BY level, source, message
ORDER BY error_count DESC, level ASC NULLS FIRST, source ASC NULLS FIRST, message ASC NULLS FIRST LIMIT 100""",
        "daily_summary_loggers": L + """SELECT partition_date, level, count(*) AS log_count,
  count(DISTINCT logger) AS unique_loggers
FROM logs GROUP BY partition_date, level ORDER BY partition_date DESC, level""",
        "daily_summary_sources_users": L + """SELECT date_partition, level, count(*) AS log_count,
  count(DISTINCT source) AS unique_sources, count(DISTINCT user_id) AS unique_users
FROM logs GROUP BY date_partition, level ORDER BY date_partition DESC, level""",
        "hourly_error_trends_loggers": L + """SELECT strftime("timestamp", '%Y-%m-%d %H:00:00') AS hour, level,
  count(*) AS error_count, count(DISTINCT logger) AS unique_loggers
FROM logs WHERE level IN ('ERROR', 'WARN', 'FATAL') GROUP BY 1, level ORDER BY hour DESC, level""",
        "hourly_error_trends_sources": L + """SELECT strftime("timestamp", '%Y-%m-%d %H:00:00') AS hour, level,
  count(*) AS error_count, count(DISTINCT source) AS unique_sources
FROM logs WHERE level IN ('ERROR', 'WARN', 'FATAL') GROUP BY 1, level ORDER BY hour DESC, level""",
        "logger_activity_summary": L + """SELECT logger, count(*) AS total_logs,
  CAST(sum(CASE WHEN level = 'ERROR' THEN 1 ELSE 0 END) AS BIGINT) AS error_count,
  CAST(sum(CASE WHEN level = 'WARN' THEN 1 ELSE 0 END) AS BIGINT) AS warn_count,
  CAST(sum(CASE WHEN level = 'INFO' THEN 1 ELSE 0 END) AS BIGINT) AS info_count,
  max("timestamp") AS latest_log, min("timestamp") AS first_log
FROM logs GROUP BY logger ORDER BY total_logs DESC, logger ASC NULLS FIRST""",
        "source_activity_summary": L + """SELECT source, count(*) AS total_logs,
  CAST(sum(CASE WHEN level = 'ERROR' THEN 1 ELSE 0 END) AS BIGINT) AS error_count,
  CAST(sum(CASE WHEN level = 'WARN' THEN 1 ELSE 0 END) AS BIGINT) AS warn_count,
  CAST(sum(CASE WHEN level = 'INFO' THEN 1 ELSE 0 END) AS BIGINT) AS info_count,
  CAST(sum(CASE WHEN level = 'DEBUG' THEN 1 ELSE 0 END) AS BIGINT) AS debug_count,
  max("timestamp") AS latest_log, min("timestamp") AS first_log
FROM logs GROUP BY source ORDER BY total_logs DESC, source ASC NULLS FIRST""",
        "exception_summary": L + """SELECT COALESCE(exception_class, 'No Exception') AS exception_class,
  COALESCE(exception_message, 'No Message') AS exception_type,
  occurrence_count, latest_occurrence, affected_loggers
FROM (
  SELECT exception_class, exception_message, count(*) AS occurrence_count,
    max("timestamp") AS latest_occurrence,
    array_to_string(list_sort(list(DISTINCT logger)), '|') AS affected_loggers
  FROM logs WHERE level = 'ERROR' GROUP BY exception_class, exception_message
  ORDER BY occurrence_count DESC, exception_class ASC NULLS FIRST, exception_message ASC NULLS FIRST
  LIMIT 50
)""",
        "user_activity_summary": L + """SELECT user_id, count(*) AS total_activity,
  count(DISTINCT session_id) AS unique_sessions, count(DISTINCT ip_address) AS unique_ip_addresses,
  CAST(sum(CASE WHEN level = 'ERROR' THEN 1 ELSE 0 END) AS BIGINT) AS error_count,
  max("timestamp") AS latest_activity, min("timestamp") AS first_activity
FROM logs WHERE user_id IS NOT NULL GROUP BY user_id
ORDER BY total_activity DESC, user_id ASC LIMIT 1000""",
        "ip_address_analysis": L + """SELECT ip_address, count(*) AS total_requests,
  count(DISTINCT user_id) AS unique_users, count(DISTINCT session_id) AS unique_sessions,
  CAST(sum(CASE WHEN level = 'ERROR' THEN 1 ELSE 0 END) AS BIGINT) AS error_count,
  max("timestamp") AS latest_request, min("timestamp") AS first_request
FROM logs WHERE ip_address IS NOT NULL GROUP BY ip_address
ORDER BY total_requests DESC, ip_address ASC LIMIT 500""",
        "error_summary": L + """SELECT level, source, count(*) AS error_count, max("timestamp") AS latest_occurrence
FROM logs WHERE level IN ('ERROR', 'WARN') GROUP BY level, source
ORDER BY error_count DESC, level, source""",
        "daily_level_counts": L + """SELECT date_partition, level, count(*) AS log_count
FROM logs GROUP BY date_partition, level ORDER BY date_partition DESC, level""",
        "level_distribution": L + """SELECT level, count(*) AS "count" FROM logs GROUP BY level
ORDER BY "count" DESC, level""",
        "total_count": L + "SELECT count(*) AS total_records FROM logs",
        "latest_rows": L + f"""SELECT {_LOG_COLS} FROM logs
ORDER BY "timestamp" DESC NULLS LAST, {_LOG_ORDER_REST} LIMIT 10""",
        "sample_rows": L + f"""SELECT {_LOG_COLS} FROM logs
ORDER BY "timestamp" ASC NULLS FIRST, {_LOG_ORDER_REST} LIMIT 10""",
        "level_overview_recent": L + f"""SELECT level, count(*) AS log_count, count(DISTINCT logger) AS unique_loggers
FROM logs WHERE partition_date >= DATE '{AS_OF}' - 7 GROUP BY level
ORDER BY log_count DESC, level""",
        "top_error_loggers_recent": L + f"""SELECT logger, count(*) AS error_count,
  count(DISTINCT exception_class) AS unique_exceptions
FROM logs WHERE level = 'ERROR' AND partition_date >= DATE '{AS_OF}' - 7 GROUP BY logger
ORDER BY error_count DESC, logger ASC NULLS FIRST LIMIT 10""",
        "http_traffic": A + f"""SELECT http_status, http_method, count(*) AS request_count,
  avg(response_size) AS avg_response_size
FROM access_logs WHERE http_method IS NOT NULL AND partition_date = DATE '{AS_OF}'
GROUP BY http_status, http_method ORDER BY request_count DESC, http_status, http_method""",
        "top_paths": A + """SELECT http_path, count(*) AS request_count
FROM access_logs WHERE http_method IS NOT NULL GROUP BY http_path
ORDER BY request_count DESC, http_path ASC NULLS FIRST LIMIT 100""",
        "parse_access_lines": A + "SELECT * FROM access_logs",
        "access_quarantine": A + "SELECT * FROM access_bad",
        "parse_access_lines_dash_size": AD + "SELECT * FROM access_logs",
        "access_quarantine_dash_size": AD + "SELECT * FROM access_bad",
        "access_table": _access_table_sql(),
        **_write_oracles(),
    }


def _write_oracles() -> dict[str, str]:
    J = f"WITH {JSON_CTES}\n"
    M = f"WITH {MIXED_CTES}\n"
    mixed = f"SELECT {_APP_COLS} FROM access_logs UNION ALL SELECT {_APP_COLS} FROM json_logs"
    no_ingest = _APP_COLS.replace("ingestion_timestamp, ", "")
    L = f"WITH {LOGS_CTE}\n"
    simple = f"""SELECT date_trunc('second', "timestamp") AS "timestamp",
  level, source AS service, message, props AS metadata, TIMESTAMP '{INGEST_TS}' AS ingestion_time"""
    daily_refresh = """SELECT date_partition, level, count(*) AS log_count,
  count(DISTINCT source) AS unique_sources, count(DISTINCT user_id) AS unique_users
FROM logs GROUP BY date_partition, level"""
    columns = ", ".join(f"['{f.name}', '{f.dataType.simpleString()}']" for f in schemas.LOGS_SERVICE.fields)
    return {
        "json_logs": J + f"SELECT {_APP_COLS} FROM json_logs",
        "json_quarantine": J + "SELECT * FROM json_bad",
        "json_values": J + f"SELECT {_APP_COLS} FROM json_logs",
        "mixed_logs": M + mixed,
        "mixed_quarantine": M + "SELECT * FROM access_bad UNION ALL SELECT * FROM json_bad",
        "ingest_job": M + mixed,
        "ingest_single_pass": M + mixed,
        "ingest_single_pass_rejects": M + "SELECT * FROM access_bad UNION ALL SELECT * FROM json_bad",
        "incremental_ingest": M + f"SELECT {no_ingest} FROM ({mixed})",
        "incremental_single_pass": M + f"SELECT {no_ingest} FROM ({mixed})",
        "incremental_single_pass_rejects": M + "SELECT * FROM access_bad UNION ALL SELECT * FROM json_bad",
        "stream_ingest": J + "SELECT * FROM stream_logs",
        "stream_single_pass": J + "SELECT * FROM stream_logs",
        "stream_single_pass_rejects": J + "SELECT * FROM json_bad",
        "service_lake_recent": L + f"""SELECT "timestamp", level, message, source, user_id, session_id, ip_address,
  TIMESTAMP '{INGEST_TS}' AS ingested_at, '{BATCH_ID}' AS batch_id, date_partition
FROM logs WHERE date_partition >= DATE '{AS_OF}' - 7""",
        "aggregate_then_refresh": L + daily_refresh,
        "script_verdict": L + """SELECT source, count(*) AS n, true AS passed_half, false AS passed_nine_tenths
FROM logs WHERE level = 'ERROR' GROUP BY source""",
        "recreated_access_table": _access_table_sql(),
        "table_with_properties": L + simple + ", 'observability' AS owner_team FROM logs",
        "catalog_listing": L + f"""SELECT 'logs' AS table_name, c[1] AS col_name, c[2] AS data_type, (SELECT count(*) FROM logs) AS row_count
FROM (SELECT unnest([{columns}]) AS c)""",
        "table_check": L + """SELECT level, count(*) AS "count", (SELECT count(*) FROM logs) AS total_records FROM logs GROUP BY level""",
        "late_files": J + f"SELECT {no_ingest} FROM json_logs",
        "repeated_batch": M + mixed,
        "repeated_batch_rejects": M + "SELECT * FROM access_bad UNION ALL SELECT * FROM json_bad",
        "ledger_ingest": J + f"SELECT {_APP_COLS} FROM json_logs",
        "latest_rows_stored": L + f"""SELECT {_SERVICE_ROW_COLS} FROM logs
ORDER BY "timestamp" DESC NULLS LAST, {", ".join(f"{c} ASC NULLS FIRST" for c in _SERVICE_ROW_COLS.split(", ")[1:])} LIMIT 10""",
        "hourly_refresh": J + """SELECT strftime(date_trunc('hour', "timestamp"), '%Y-%m-%d %H:00:00') AS hour, level,
  count(*) AS error_count, count(DISTINCT logger) AS unique_loggers
FROM json_logs WHERE level IN ('ERROR', 'WARN', 'FATAL') GROUP BY ALL""",
        "users_refresh": L + daily_refresh,
        "window_users": L + f"""SELECT level, count(DISTINCT user_id) AS unique_users
FROM logs WHERE date_partition >= DATE '{AS_OF}' - 7 AND user_id IS NOT NULL GROUP BY level""",
        "replaced_partitioned_table": L + f"""SELECT "timestamp", level, message, source, user_id, session_id, ip_address,
  TIMESTAMP '{INGEST_TS}' AS ingested_at, '{BATCH_ID}' AS batch_id, date_partition FROM logs WHERE level <> 'DEBUG'""",
        "simple_logs": L + simple + " FROM logs",
        "daily_refresh": L + daily_refresh,
        "sql_script": L + """SELECT 1 AS statement_index, CAST(0 AS BIGINT) AS row_count, true AS success
UNION ALL SELECT 2, (SELECT count(*) FROM (SELECT 1 FROM logs WHERE level IN ('ERROR', 'WARN')
                                           GROUP BY level, logger, message) q), true
UNION ALL SELECT 3, 0, false
UNION ALL SELECT 4, (SELECT count(*) FROM (SELECT 1 FROM logs GROUP BY logger) q), true""",
    }


def oracle_sql() -> dict[str, str]:
    sql = _statements()
    # The summary tables hold what the direct queries return.
    common = {"top_errors_by_count": "top_errors_by_source", "daily_log_summary": "daily_summary_sources_users", "hourly_error_trends": "hourly_error_trends_sources"}
    own = {name: name for name in ("source_activity_summary", "user_activity_summary", "ip_address_analysis", "logger_activity_summary", "error_summary")}
    sql["aggregation_service"] = _contents(contract.SERVICE_CONTENTS, common | own, sql)
    sql["service_shared_scan"] = sql["aggregation_service"]
    sql["aggregation_fallback"] = _contents(contract.FALLBACK_CONTENTS, own | {"daily_summary": "daily_level_counts"}, sql)
    app = {"top_errors_by_count": "top_errors_by_logger", "daily_log_summary": "daily_summary_loggers", "hourly_error_trends": "hourly_error_trends_loggers", "exception_summary": "exception_summary"}
    sql["app_summary_tables"] = _contents(contract.APP_CONTENTS, app | own, sql)
    # The shared-scan (rollup) forms of Q3, Q5 and Q7 must equal the direct queries.
    for name in ("daily_summary_loggers", "hourly_error_trends_loggers", "logger_activity_summary"):
        sql[f"{name}_rollup"] = sql[name]
    return sql
