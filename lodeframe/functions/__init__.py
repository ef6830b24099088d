"""Aggregation functions."""

from .aggregates import AggregationFn, Count, Fold, Max

__all__ = ["AggregationFn", "Count", "Fold", "Max"]
