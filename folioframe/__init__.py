"""folioframe: scanned-document layout analytics as Spark DataFrames."""

__version__ = "0.1.0"
