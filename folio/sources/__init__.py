"""Readers of files, pages and recognised text."""
