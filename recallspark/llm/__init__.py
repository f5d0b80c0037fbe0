"""Operators that prepare training text. Optional: nothing outside this folder imports them."""
