"""Training-data operators: deduplication, quality, privacy, sharding, formatting, language, tokens."""
