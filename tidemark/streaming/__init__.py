"""Structured Streaming faces of batch operators that hold state per recording."""
