"""Training-data operators: sharding, deduplication, packing, search, mixing, classifiers, archives."""
