"""Metadata: versions, pruning, compaction plans."""
