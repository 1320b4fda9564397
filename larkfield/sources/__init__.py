"""Readers, writers, keyed upserts and snapshots."""
