"""Operators for preparing training text. Queries are in queries.py; nothing else in the library imports this subpackage."""
