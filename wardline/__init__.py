"""Facility intelligence as Spark DataFrame operators."""
