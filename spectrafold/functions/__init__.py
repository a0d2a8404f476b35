"""Column expressions: scalar transforms, aggregates, rules and fixed values."""
