"""Operators for the preparation of training text: one module each, queries in ``queries``."""
