"""Coastal radar data on Spark."""
