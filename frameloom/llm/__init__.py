"""Training-data operators: dedup, filters, classifiers, packing, tokenising and secret scans.

Nothing outside this subpackage imports it.
"""
