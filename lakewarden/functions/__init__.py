"""Scalar functions for rule expressions and contracts, all as native expressions."""
