"""Column functions of text analysis."""
