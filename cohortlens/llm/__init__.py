"""Operators for preparing training text; see the README's section on them."""
