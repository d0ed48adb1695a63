"""Facts: the relations that queries are asked of."""
