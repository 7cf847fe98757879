"""Operators for building training corpora: mixing, archiving, sharding, dedup, filtering and encoding.

Nothing else in the library imports this subpackage.
"""
