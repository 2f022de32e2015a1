"""Scalar functions that return Columns."""
