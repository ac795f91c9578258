"""Structured Streaming over the same operators (an extension)."""
