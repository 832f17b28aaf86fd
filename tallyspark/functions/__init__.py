"""Column-level building blocks: lenient casts, safe arithmetic, dates."""
