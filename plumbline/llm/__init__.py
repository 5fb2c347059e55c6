"""Operators that prepare text and vectors for model training."""
