"""Incremental consolidation of metric shards."""
