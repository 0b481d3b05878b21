"""leafmill: document-text extraction and service bookkeeping as Spark DataFrame jobs."""

__version__ = "0.1.0"
