"""DuckDB SQL that states each query's result independently of the Spark code."""

from oracles.catalog import oracle_sql

__all__ = ["oracle_sql"]
