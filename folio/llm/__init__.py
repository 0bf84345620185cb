"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it; ``queries.py`` holds the thin
queries that apply the operators to the standard tables.
"""
