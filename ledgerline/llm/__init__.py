"""Training-data operators: deduplication, packing, quality, mixing, encoding, language."""
