"""Column expressions and batch UDFs used by the operators."""
