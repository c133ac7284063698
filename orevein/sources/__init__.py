"""Catalog files, registries and sinks."""
