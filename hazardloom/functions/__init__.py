"""Column functions: plain native expressions, no Python UDFs."""
