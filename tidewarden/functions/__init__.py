"""Reusable DataFrame operators of the analytics engine."""
