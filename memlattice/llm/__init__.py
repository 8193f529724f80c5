"""Operators for preparing text and vector collections; nothing else in the library imports this package."""
