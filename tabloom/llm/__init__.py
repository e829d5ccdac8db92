"""Training-data operators: sharding, near-duplicate search, archives, scoring, mixing and packing.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
