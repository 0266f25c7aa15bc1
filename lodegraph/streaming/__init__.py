"""Structured Streaming forms of operators over deliveries."""
