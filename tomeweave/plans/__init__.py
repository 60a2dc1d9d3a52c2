"""Composed jobs and the registry of queries."""
