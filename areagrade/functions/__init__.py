"""Column expressions; all built-in, no Python UDFs."""
