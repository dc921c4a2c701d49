"""Column functions: numbers, text, notes, taxonomy."""
