"""Corpus preparation operators for training text."""
