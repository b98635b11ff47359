"""Scalar functions that Spark has no built-in for, as column expressions."""
