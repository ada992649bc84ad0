"""Whole pipelines over the test tables, and their SQL."""
