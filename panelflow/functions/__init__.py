"""Column expressions: each takes a Column (or name) and returns a Column."""
