"""Structured Streaming forms of what is incremental: arriving files and clicks."""
