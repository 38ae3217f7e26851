"""Relational operators of sparse retrieval: matrices, statistics, scoring, search, metrics, checks, effects, bases and selection."""
