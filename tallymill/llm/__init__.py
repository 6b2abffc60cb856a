"""Operators for preparing training text at scale; each is a DataFrame job of its own.

Nothing else in the library imports this package. `queries.py` registers one query per operator.
"""
