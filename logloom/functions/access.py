"""Access-log (combined format) parsing with built-in regex functions. No UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.timeutil import utc_wall_clock

# ---------------------------------------------------------------------------------------------
# These must stay exactly as they are for results to agree with the reference.
#
# Combined-format line: address, "- -", [time], "METHOD path HTTP/version", status, size,
# "referer", "user agent". Matched at the start of the line; trailing text is allowed.
ACCESS_LINE_PATTERN = r'(\S+) - - \[([^\]]+)\] "(\S+) ([^"]*) HTTP/[^"]*" (\d+) (\d+) "([^"]*)" "([^"]*)"'
# Time inside the brackets, e.g. 06/Nov/2024:00:45:41 +0000.
ACCESS_TIME_FORMAT = "dd/MMM/yyyy:HH:mm:ss Z"
# Constant fields of every parsed access line.
ACCESS_LOGGER = "apache.access"
ACCESS_THREAD = "http-worker"
ACCESS_SOURCE_FILE = "access.log"
HTTP_ERROR_CLASS = "HttpError"
# message: "{method} {path} - {status}"; exception message: "HTTP {status}".
# Dash placeholder for an absent referer, user agent or size.
DASH = "-"
# ---------------------------------------------------------------------------------------------

# Same grammar, but a size of "-" is accepted (and read as 0). Off by default.
ACCESS_LINE_PATTERN_DASH_SIZE = (
    r'(\S+) - - \[([^\]]+)\] "(\S+) ([^"]*) HTTP/[^"]*" (\d+) (\d+|-) "([^"]*)" "([^"]*)"'
)

# Full access-table grammar: identity and user are free fields, protocol is kept.
# Groups: ip, ident, user, time, method, url, protocol, status, size, referer, agent.
ACCESS_TABLE_PATTERN = (
    r'(\S+) (\S+) (\S+) \[([^\]]+)\] "(\S+) ([^"]*) (HTTP/[^"]*)" (\d+) (\d+|-) "([^"]*)" "([^"]*)"'
)

ACCESS_GROUPS = ("ip", "time", "method", "path", "status", "size", "referer", "agent")
ACCESS_TABLE_GROUPS = (
    "ip", "ident", "user", "time", "method", "url", "protocol", "status", "size", "referer", "agent",
)

# Joins the captured groups for a single-pass extraction. Any character works: a line whose
# groups happen to contain it is recognised (wrong number of parts) and re-extracted group
# by group, so the result is exact for every input.
_GROUP_SEPARATOR = "\u0001"
# Every line is prefixed with _LINE_MARK before the rewrite, and a matching line is rewritten to
# start with _MATCH_MARK. An unmatched line comes out unchanged, still starting with _LINE_MARK
# whatever its own text, so the rewrite alone tells matched from unmatched lines.
_LINE_MARK = "\u0002"
_MATCH_MARK = "\u0003"


def anchored(pattern: str) -> str:
    """Java's ``find`` is unanchored; a match must start at the beginning of the line."""
    return "^" + pattern


def capture_groups(lines: DataFrame, column: str, pattern: str, names: tuple[str, ...], out: str = "m") -> DataFrame:
    """Add ``out``: the array of the capture groups of ``pattern`` matched at the start of the
    line, NULL when the line does not match. Group ``names[i]`` is ``out[i]``.

    The regex runs once per line: one ``regexp_replace`` rewrites a (marked) matching line
    into a match mark and its groups joined by a separator, and one ``split`` cuts them
    apart; an unmatched line keeps its line mark. There is no separate match test and no
    ``regexp_extract`` per group. The steps are separate projections, each referenced more
    than once, so the optimizer keeps the rewrite computed once and each generated method
    small.
    """
    n = len(names)
    line = F.col(column)
    template = _MATCH_MARK + _GROUP_SEPARATOR.join(f"${i}" for i in range(1, n + 1))
    rewritten = lines.withColumn(
        "_rw", F.regexp_replace(F.concat(F.lit(_LINE_MARK), line), "(?s)^" + _LINE_MARK + pattern + ".*", template)
    )
    rw = F.col("_rw")
    staged = rewritten.withColumns(
        {"_ok": rw.startswith(_MATCH_MARK), "_parts": F.split(F.substring(rw, 2, 2**31 - 1), _GROUP_SEPARATOR)}
    )
    head = anchored(pattern)
    exact = F.array(*[F.regexp_extract(line, head, i + 1) for i in range(n)])
    groups = F.when(~F.col("_ok"), F.lit(None)).when(F.size("_parts") == n, F.col("_parts")).otherwise(exact)
    return staged.withColumn(out, groups).drop("_rw", "_ok", "_parts")


def group(m: str, names: tuple[str, ...], name: str) -> Column:
    """The group called ``name`` of a ``capture_groups`` array column."""
    return F.col(m).getItem(names.index(name))


def access_time(text: Column) -> Column:
    """Bracketed access-log time to UTC ``timestamp_ntz``; NULL when it is not a valid time.

    Any offset is applied, so ``+0530`` lines land on the right instant.
    """
    return utc_wall_clock(F.try_to_timestamp(text, F.lit(ACCESS_TIME_FORMAT)))


def status_level(status: Column) -> Column:
    """HTTP status to a log level: 5xx ERROR, 4xx WARN, anything else INFO."""
    return F.when(status >= 500, "ERROR").when(status >= 400, "WARN").otherwise("INFO")


def dash_to_null(text: Column) -> Column:
    """Referer and user agent: ``-`` means absent."""
    return F.nullif(text, F.lit(DASH))


def size_value(text: Column) -> Column:
    """Response size: ``-`` is 0, digits are an int, anything larger than an int is NULL."""
    return F.when(text == DASH, F.lit(0)).otherwise(text.try_cast("int"))
