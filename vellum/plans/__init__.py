"""Whole plans: ingest, answering, and the driver's queries."""
