"""Operators for building training data; nothing outside this package imports it."""
