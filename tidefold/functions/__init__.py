"""functions of the table-compaction engine."""
