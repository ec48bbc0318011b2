"""Structured Streaming versions of append-only log aggregates."""
