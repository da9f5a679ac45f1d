"""The same operators on streaming frames (Structured Streaming)."""
