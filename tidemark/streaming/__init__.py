"""Structured Streaming: folds of change streams and stateful processors."""
