"""Streaming sinks."""
