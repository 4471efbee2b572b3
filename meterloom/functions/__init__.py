"""Column expressions, no UDFs."""
