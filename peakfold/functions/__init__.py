"""Column functions and the small fixed tables."""
