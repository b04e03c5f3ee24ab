"""Security triage over large tables and streams, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
