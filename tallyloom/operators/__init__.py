"""Relational operators over DataFrames, generic in their column names."""
