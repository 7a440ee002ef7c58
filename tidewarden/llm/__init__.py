"""Operators for preparing training text: filters, de-duplication, mixing, archives and tokens."""
