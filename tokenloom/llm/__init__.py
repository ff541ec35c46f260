"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it; ``queries`` holds the thin query
functions and the SQL they are checked against.
"""
