"""Readers with fixed schemas and tolerant parsing, and idempotent writers."""
