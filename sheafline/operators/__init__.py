"""Operators on frames, tables and mappings."""
