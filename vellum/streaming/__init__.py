"""Structured Streaming over feedback and chunks: an extension of the batch engine."""
