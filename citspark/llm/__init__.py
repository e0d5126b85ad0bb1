"""Operators for large-scale training-data pipelines.

One module an operator; :mod:`citspark.llm.queries` registers one query for
each.  Nothing outside this package imports it.
"""
