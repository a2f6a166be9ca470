"""Training-data operators: counting, mixing, deduplication, filtering and packing of corpora."""
