"""Column expressions: text, dates, addresses, numbers."""
