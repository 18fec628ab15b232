"""Readers of dumps, and sinks."""
