"""Training-data operators: filters, sharding, search, classifiers, tokenizers, near-duplicates.

Nothing outside this subpackage imports it.
"""
