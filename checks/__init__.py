"""Queries over the given tables, their SQL twins, and the comparison of both."""
