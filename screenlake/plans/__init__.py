"""Registered queries, grouped by area."""
