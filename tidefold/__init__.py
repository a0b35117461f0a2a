"""Table compaction, merge-on-read and corpus operators on Spark DataFrames."""
