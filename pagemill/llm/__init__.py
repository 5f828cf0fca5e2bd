"""Operators for preparing training text at corpus scale.

Nothing outside this folder imports it.  Each module holds one operator; the
thin queries that bind them to the test tables are in ``queries.py``.
"""
