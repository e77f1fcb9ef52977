"""Whole workloads, and the registered queries with SQL for the same rows."""
