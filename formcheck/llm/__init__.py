"""Operators for preparing training data at scale; nothing else in formcheck imports this package."""
