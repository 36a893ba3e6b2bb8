"""Document-to-answer analytics on Spark: ingest, chunk, encode, index, search, gate and answer, as DataFrame operations."""

__version__ = "0.1.0"
