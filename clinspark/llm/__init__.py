"""Training-data operators: tokenisation, deduplication, decontamination, filters, sharding and search.

Nothing else in the library imports this subpackage.
"""
