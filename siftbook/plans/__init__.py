"""Registered queries: each binds operators to the given tables and has a SQL twin where one exists."""
