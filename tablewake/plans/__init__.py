"""Whole jobs, and the registry of queries with their reference SQL."""
