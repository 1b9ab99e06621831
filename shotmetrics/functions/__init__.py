"""Column functions: everything here builds native expressions, no Python UDFs."""
