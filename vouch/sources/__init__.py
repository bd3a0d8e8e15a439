"""Readers of raw files and tables, and the keyed table store."""
