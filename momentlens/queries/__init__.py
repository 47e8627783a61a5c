"""Queries over the test tables, with SQL for comparison."""
