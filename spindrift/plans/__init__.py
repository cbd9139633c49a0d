"""Whole plans: the crawl fixpoint, its builder and its reports."""
