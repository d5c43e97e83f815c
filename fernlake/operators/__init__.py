"""Operators over DataFrames: fitted ones have ``fit`` and a model with ``transform``."""
