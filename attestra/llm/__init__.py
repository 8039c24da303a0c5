"""Operators for preparing language-model training data. Nothing else in attestra imports this package."""
