"""Readers, the page store and crawl snapshots."""
