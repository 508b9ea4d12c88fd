"""Column expressions: text, rules, scores."""
