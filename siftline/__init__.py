"""siftline: Spark operators for triaging fraudulent records in labelled text."""

__version__ = "0.1.0"
