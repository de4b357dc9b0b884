"""Column expressions and small pandas UDFs."""
