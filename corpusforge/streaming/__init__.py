"""Streams of records and of log events."""
