"""Tidemark: behavioural analytics over event streams, declared as Spark plans."""

__version__ = "0.1.0"
