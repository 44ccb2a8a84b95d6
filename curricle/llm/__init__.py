"""Training-data operators: tokenising, archives, sketches, sharding, deduplication, packing and quality."""
