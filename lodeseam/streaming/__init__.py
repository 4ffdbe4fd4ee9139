"""Incremental indexing of a stream of chunks."""
