"""Metrics and scalar helpers."""
