"""Compositions: the Gold load, the star schema, measures and reports."""
