"""Operators on documents, lines, pages and blocks."""
