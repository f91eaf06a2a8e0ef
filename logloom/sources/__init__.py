"""Readers: raw log files, curated tables, lake paths, generated and literal rows, and log
input derived from the driver's ``events`` table."""
