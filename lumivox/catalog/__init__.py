"""Registered queries over the given tables, and the same results in DuckDB SQL."""
