"""Spark DataFrame operators that turn raw app-store reviews into weekly theme reports."""

__version__ = "0.1.0"
