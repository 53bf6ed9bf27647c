"""Streaming forms of the append-only log."""
