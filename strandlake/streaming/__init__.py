"""Structured Streaming twins of the event queries."""
