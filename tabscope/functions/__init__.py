"""Column expressions: missing values, text rules, score rules."""
