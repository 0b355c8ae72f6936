"""Operators on long count tables, model frames and reads."""
