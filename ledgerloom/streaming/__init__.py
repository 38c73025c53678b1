"""Structured Streaming jobs that share their expressions with the batch operators."""
