"""Column expressions and the fixed patterns they use."""
