"""Layered (raw -> bronze -> silver -> gold) analytics on plain PySpark."""

__version__ = "0.1.0"
