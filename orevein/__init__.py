"""Catalog harmonisation and procurement analytics on Spark."""
