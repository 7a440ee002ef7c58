"""Registered queries by family."""
