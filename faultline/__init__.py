"""Faultline: defect lifecycle analytics (ratings, complaints, investigations, recalls) on Spark."""

from faultline.sources.tables import Tables, read_catalog, read_parquet
from faultline.sources.roles import role_tables

__all__ = ["Tables", "read_catalog", "read_parquet", "role_tables"]
