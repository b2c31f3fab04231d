"""End-to-end plans that chain operators and write tables."""
