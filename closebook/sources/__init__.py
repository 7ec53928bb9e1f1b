"""Reading source tables and files, and writing lake tables."""
