"""Column expressions shared by the operators (names, text, NaN handling, SQL text)."""
