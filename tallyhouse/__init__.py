"""Tallyhouse: retail analytics as Spark DataFrame operators."""
