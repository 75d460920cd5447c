"""Scalar functions as native column expressions."""
