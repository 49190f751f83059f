"""Whole jobs composed from the operators and driven by a recipe."""
