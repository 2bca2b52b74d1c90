"""Tables in and out."""

from depguard.sources.read import read_csv_ints, read_jdbc, read_lines, read_table, read_text_with_header
from depguard.sources.write import logical_name, write_repaired, write_report

__all__ = ["logical_name", "read_csv_ints", "read_jdbc", "read_lines", "read_table", "read_text_with_header", "write_repaired", "write_report"]
