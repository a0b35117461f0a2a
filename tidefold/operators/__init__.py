"""operators of the table-compaction engine."""
