"""Incremental maintenance, and its use on streams."""
