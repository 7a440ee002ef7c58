"""Structured Streaming: folds with late data, keyed state, idempotent sinks."""
