"""Operators for training-data pipelines.  Nothing outside of this package imports it."""
