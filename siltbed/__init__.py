"""Keyed op-log analytics on PySpark."""
