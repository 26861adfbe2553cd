"""Column functions: text, JSON, distance."""
