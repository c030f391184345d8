"""Readers of tables, signals, pictures and annotations."""
