"""Relational operators on DataFrames."""

from .relational import block_product, chunk_scan, group_by, index_join, index_select, materialize, merge_join, product, project, select, sort, table_scan

__all__ = ["block_product", "chunk_scan", "group_by", "index_join", "index_select", "materialize", "merge_join", "product", "project", "select", "sort", "table_scan"]
