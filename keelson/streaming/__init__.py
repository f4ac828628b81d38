"""Structured Streaming: ring-slot assignment and latest-value views."""
