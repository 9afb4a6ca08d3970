"""formweave: document-integrity and filing analytics as Spark DataFrame jobs."""

__version__ = "0.1.0"
