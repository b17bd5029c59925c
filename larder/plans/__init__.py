"""Registered queries, their SQL and whole pipelines."""
