"""Operators for building training data at scale (one module per operator)."""
