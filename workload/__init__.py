"""Queries over the benchmark tables, each with its SQL counterpart."""
