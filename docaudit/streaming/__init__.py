"""Structured Streaming forms of the intake and status operators."""
