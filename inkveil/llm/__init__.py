"""Training-data operators: quality, deduplication, scanning, archives, sharding, packing, language models."""
