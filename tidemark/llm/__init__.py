"""Operators on training text: leaked test items, mixing of sources, cut-off texts."""
