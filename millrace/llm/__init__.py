"""Operators for preparing training data: documents, benchmark and web pages.

Nothing else in the package imports this one.
"""
