"""Operators for preparing large bodies of training text.

Nothing outside this package imports it; its queries are added to the registered
ones by ``__spark_entry__.py``.
"""
