"""Operators for preparing training text.  Nothing outside this folder imports it."""
