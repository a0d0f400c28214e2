"""Operators for large collections of training text."""
