"""Operators for large text collections, each with a registered query in ``queries``."""
