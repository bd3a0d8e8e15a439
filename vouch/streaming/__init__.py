"""Repeated import of result files as they arrive."""
