"""Registered queries, grouped by what they read."""
