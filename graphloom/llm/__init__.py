"""Training-data operators: fingerprints, packing, language ID, URL filters, mixing, token files and deduplication.

Nothing else in the library imports this subpackage.
"""
