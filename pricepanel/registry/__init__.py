"""Registered queries, the DuckDB form of each, and the panel they run on."""
