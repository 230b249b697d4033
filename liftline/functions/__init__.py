"""Column functions: pure expressions, no shuffle and no Python code per row."""
