"""Operators for training-data corpora; nothing else in the library imports them."""
