"""Palimpsest: a PySpark engine that collates many versions of a text."""
