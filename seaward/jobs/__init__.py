"""Whole jobs over many files, and the registered queries with their SQL."""
