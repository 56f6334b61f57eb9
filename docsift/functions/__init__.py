"""Column expressions over text and vectors."""
