"""Conditional-inference-tree boosting and its data operators on Spark DataFrames."""

__version__ = "0.1.0"
