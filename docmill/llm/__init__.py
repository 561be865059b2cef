"""Training-data operators: sharding, deduplication, search, extraction, scoring, tokenization."""
