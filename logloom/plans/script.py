"""Run a SQL script statement by statement; a failing statement is recorded and the rest run.

Each statement is executed by ``spark.sql`` (Spark parses, optimizes and runs it); only the
split into statements happens here, and the script is a driver-side file, not data.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

PREVIEW_CHARS = 100


@dataclass
class StatementResult:
    statement_index: int
    statement: str
    row_count: int
    success: bool
    error: str | None = None


def split_statements(script: str) -> list[str]:
    """Split on ``;`` outside quotes, backticks and comments; drop statements that are empty
    or only comments."""
    statements, current = [], []
    i, n = 0, len(script)
    quote = None  # one of ' " ` while inside a quoted section
    has_code = False
    while i < n:
        ch = script[i]
        nxt = script[i + 1] if i + 1 < n else ""
        if quote:
            current.append(ch)
            if ch == "\\" and quote != "`" and nxt:
                current.append(nxt)
                i += 2
                continue
            if ch == quote:
                quote = None
            i += 1
            continue
        if ch == "-" and nxt == "-":
            end = script.find("\n", i)
            end = n if end < 0 else end
            current.append(script[i:end])
            i = end
            continue
        if ch == "/" and nxt == "*":
            end = script.find("*/", i + 2)
            end = n if end < 0 else end + 2
            current.append(script[i:end])
            i = end
            continue
        if ch == ";":
            if has_code:
                statements.append("".join(current).strip())
            current, has_code = [], False
            i += 1
            continue
        if ch in "'\"`":
            quote = ch
        if not ch.isspace():
            has_code = True
        current.append(ch)
        i += 1
    if has_code:
        statements.append("".join(current).strip())
    return statements


def _preview(statement: str) -> str:
    return statement[:PREVIEW_CHARS] + "..." if len(statement) > PREVIEW_CHARS else statement


def run_statements(spark: SparkSession, script: str) -> list[StatementResult]:
    """Execute each statement; a statement whose result has columns is counted (one job)."""
    results = []
    for index, statement in enumerate(split_statements(script), start=1):
        try:
            df = spark.sql(statement)
            rows = df.count() if df.columns else 0
            results.append(StatementResult(index, _preview(statement), rows, True))
        except Exception as exc:  # recorded, and the script goes on
            results.append(StatementResult(index, _preview(statement), 0, False, str(exc)))
    return results


def script_passed(results: list[StatementResult], *, min_success_rate: float = 0.5, empty_ok: bool = True) -> bool:
    """A script fails when fewer than ``min_success_rate`` of its statements succeeded.
    An empty script passes when ``empty_ok``."""
    if not results:
        return empty_ok
    return sum(r.success for r in results) / len(results) >= min_success_rate


def report_frame(spark: SparkSession, results: list[StatementResult]) -> DataFrame:
    """The per-statement results as a DataFrame."""
    schema = "statement_index int, statement string, row_count bigint, success boolean, error string"
    return spark.createDataFrame([asdict(r) for r in results], schema)
