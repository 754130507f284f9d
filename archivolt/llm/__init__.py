"""Operators for building training data from a corpus; nothing else in the package imports them."""
