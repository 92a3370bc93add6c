"""Operators for preparing training data: scoring, joins, sharding, archives, packing and rules.

Nothing outside this package imports it; its queries are in ``queries.py``.
"""
