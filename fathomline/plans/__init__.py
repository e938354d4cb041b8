"""Composite plans: lanes, annual tables, the signal pipeline."""
