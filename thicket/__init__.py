"""Grouped graph learning and the relational operations around it, on Spark."""
