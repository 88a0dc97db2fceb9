"""Writing tables out."""

from burnish.sinks.writers import csv_lines, insert_statements, json_lines, preview, write_csv, write_json, write_sql

__all__ = ["csv_lines", "insert_statements", "json_lines", "preview", "write_csv", "write_json", "write_sql"]
