"""Column expressions: text and document rules."""
