"""Relational operators of a crawl: frontier, chains, event log, ordered folds."""
