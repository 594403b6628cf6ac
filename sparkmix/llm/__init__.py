"""Training-data operators: media, tokens, dedup, packing, sharding, classifiers."""
