"""Stored tables, their catalog, and Parquet folders."""

from ..plans.planner import parquet_tables
from .store import Store, Transaction

__all__ = ["Store", "Transaction", "parquet_tables"]
