"""Incremental maintenance of panel tables."""
