"""Training-data operators: dedup, sharding, counts, quality, encoding, mixing, privacy.

Nothing else in the library imports this subpackage.
"""
