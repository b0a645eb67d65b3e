"""Operators for training text and keys; nothing else in the library imports this package."""
