"""Column expressions: vectors, texts, dates and JSON."""
