"""Structured Streaming forms of the operators that work on a growing input."""
