"""plans of the table-compaction engine."""
