"""Spindrift: crawl dataflows and corpus analytics expressed as Spark plans."""
