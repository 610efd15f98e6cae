"""Training-data operators: deduplication, filtering, mixing, sharding and tokenising of text corpora.

Nothing outside this subpackage imports it.
"""
