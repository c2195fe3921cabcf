"""Training-data operators: quality, near-duplicates, packing, search, language, toxicity, sharding, tokens.

Nothing else in the library imports this subpackage.
"""
