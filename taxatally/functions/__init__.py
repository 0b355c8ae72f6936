"""Column functions: no shuffle, no state, all built-in expressions."""
