"""Registered queries and their DuckDB SQL."""
