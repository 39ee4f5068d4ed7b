"""Structured Streaming sources, operators and sinks."""
