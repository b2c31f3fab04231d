"""Governed decisions over Spark tables and streams."""
