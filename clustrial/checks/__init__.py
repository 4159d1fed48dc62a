"""Queries on the order, event and part tables, and the SQL they are checked with."""
