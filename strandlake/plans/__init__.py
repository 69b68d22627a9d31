"""Registered queries: whole tables in, with the DuckDB SQL that says the same."""
