"""Operators for preparing training text at large scale.  Nothing outside this folder imports it."""
