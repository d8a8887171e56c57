"""Training-data operators: tokenizing, search, similarity joins, language ID, sharding, dedup and mixing."""
