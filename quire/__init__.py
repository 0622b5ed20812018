"""Quire: paged-book and page-table analytics written as ordinary Spark queries."""
