"""Search-analytics building blocks."""
