"""Column expressions and small numeric helpers."""
