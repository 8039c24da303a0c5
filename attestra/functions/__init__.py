"""Column expressions: text rules, numbers, identity."""
