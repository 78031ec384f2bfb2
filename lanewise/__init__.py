"""Event-sequence analytics on PySpark: tracks, notations, grading, triage."""

__version__ = "0.1.0"
