"""Operators for large-scale training-data pipelines.

Nothing else in ``circlet`` imports this subpackage.
"""
