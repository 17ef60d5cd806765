"""Readers of text, log and report files, and generators of keyed rows."""
