"""Training-data operators: deduplication, filtering, mixing, packing, archives."""
