"""Plans: operators put together over the given tables."""
