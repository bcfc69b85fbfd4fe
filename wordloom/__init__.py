"""Timed-sequence analytics on PySpark: pure ``DataFrame -> DataFrame`` operators."""
