"""Reading and writing split tables."""
