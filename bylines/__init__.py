"""Contribution-role analytics as Spark DataFrame operators."""
