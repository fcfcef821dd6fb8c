"""Monitors as Structured Streaming jobs."""
