"""Training-data operators: deduplication, filtering, counting and packing of text corpora.

Nothing outside this subpackage imports it; ``queries`` holds the entry points of the driver.
"""
