"""Durable, versioned key-value data as DataFrames: an ordered log, its latest-write view, sorted runs and their compaction."""
