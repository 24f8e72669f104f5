"""Operators composed into whole jobs, and the views used on the sample tables."""
