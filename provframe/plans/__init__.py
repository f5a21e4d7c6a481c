"""Queries over the benchmark tables, each with the SQL its result must equal."""
