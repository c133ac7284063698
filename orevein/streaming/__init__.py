"""Continuous forms of the daily counts."""
