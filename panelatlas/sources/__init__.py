"""Bundles, shards and sinks."""
