"""Scalar sequence functions as Column expressions."""
