"""Whole queries made of operators: search, comparison, reading, catalog."""
