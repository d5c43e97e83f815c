"""Compositions of operators, and how their lineage is cut."""
