"""Sources (files, databases, the test tables) and sinks."""

from tabulon.sources.tables import TABLE_NAMES, read_table, register_tables
from tabulon.sources.files import load
from tabulon.sources.sinks import write_table, write_report
from tabulon.sources.guards import require_rows, SourceError

__all__ = ["TABLE_NAMES", "read_table", "register_tables", "load", "write_table",
           "write_report", "require_rows", "SourceError"]
