"""Scalar functions with the reference dialect's semantics."""
