"""Sparse ternary bit filters over large byte sequences, as PySpark DataFrames."""
