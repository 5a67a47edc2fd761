"""Training-data operators: sharding, filtering, deduplication, mixing and packing of text corpora."""
