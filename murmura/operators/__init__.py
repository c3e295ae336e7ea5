"""Relational operators: detection, context windows, statistics, alerts and reports."""
