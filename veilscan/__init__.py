"""Sensitive-data scanning of large text tables as Spark DataFrame operators."""
