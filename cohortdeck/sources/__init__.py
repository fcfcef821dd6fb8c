"""Reading source tables and writing summary tables."""
