"""Queries and pipelines."""
