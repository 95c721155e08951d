"""Operators, one module per topic."""
