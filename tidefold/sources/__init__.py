"""sources of the table-compaction engine."""
