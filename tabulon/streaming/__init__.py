"""Structured Streaming forms of the quality and chart aggregates."""
