"""Structured Streaming sinks and windowed statistics."""
