"""logloom: log analytics on Spark.

Parse access logs and JSON application logs into one date-partitioned log table,
then compute summary tables from it, using only DataFrame, Spark SQL and
Structured Streaming built-ins.
"""

from logloom.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
__version__ = "0.1.0"
