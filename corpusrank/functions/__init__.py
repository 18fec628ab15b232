"""Scalar and table functions: wikitext in pure Python, column expressions, and their registration in a session."""
