"""Training-data operators: cleaning, deduplication, mixing, sharding, search."""
