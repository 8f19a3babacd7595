"""Column expressions: cleaning, exact numbers, text."""
