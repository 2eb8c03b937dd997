"""Operators of a training-data pipeline. Nothing else in this package imports them."""
