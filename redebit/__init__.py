"""Recurring-payment recovery analytics as Spark DataFrame operators."""
