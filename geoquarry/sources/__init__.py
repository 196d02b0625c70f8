"""Readers: driver tables, vector formats, grids."""
