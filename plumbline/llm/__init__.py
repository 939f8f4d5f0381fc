"""Training-data operators: packing, archives, quality, mixing, sharding, deduplication, tokens, toxicity, search, URLs."""
