"""Jobs: table management and sinks, SQL scripts, and the ingest / summary pipelines."""
