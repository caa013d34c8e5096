"""Structured Streaming twins of batch jobs on instantaneous values."""
