"""Whole jobs built from the operators, and the query registry."""
