"""Operators for preparing language-model training data; nothing else in spanlake imports this package."""
