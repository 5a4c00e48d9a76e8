"""Column functions: text, pattern matches with offsets, numbers."""
