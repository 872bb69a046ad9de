"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  ``registry`` lists its queries.
"""
