"""Operators of a training-data pipeline: filters, near-duplicates, classifiers, packing and sharding.

Nothing else in the library imports this subpackage.
"""
