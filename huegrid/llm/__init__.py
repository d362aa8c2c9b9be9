"""Operators for preparing text and page corpora as training data."""
