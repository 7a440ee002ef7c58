"""Readers: driver tables as market data, and file formats."""
