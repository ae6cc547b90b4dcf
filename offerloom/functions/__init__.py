"""Column functions: text, money, article numbers."""
