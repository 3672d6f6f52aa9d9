"""Column expressions: sequence, quality, read-id and coordinate scalars."""
